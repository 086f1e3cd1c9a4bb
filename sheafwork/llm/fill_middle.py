"""Fill-in-the-middle documents: texts cut into prefix, middle and suffix at line ends, by chunk summaries.

A rolling hash over the last bytes cuts a text into chunks whose borders depend on the content
alone, so a passage that many documents share gives the same chunks in all of them. What counts about a
chunk (line ends, code points, the bytes at its borders, whether a marker lies in it) is remembered
under the chunk's bytes: a chunk met again is compared byte by byte and not scanned again. The
summaries add up, also where a border splits a character or a marker, so a running count over them
finds the chunk that holds a cut, and only that chunk is searched for it.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.llm.common import pieces

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_OVERLAP = 2  # bytes of a marker that can lie on one side of a border

WINDOW = 32
MEAN = 2048
LEAST, MOST = 256, 16_384
#: Bytes of chunks that a task remembers.
REMEMBERED_BYTES = 16 << 20
_SEGMENT = 1 << 20
_BASE = 0x9E3779B1


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2 ** 32, for a segment and a window."""
    size = _SEGMENT + 4096
    made = [np.cumprod(np.full(size, x, np.uint32), dtype=np.uint32) for x in (_BASE, pow(_BASE, -1, 1 << 32))]
    return made[0], made[1]


def borders(raw: np.ndarray, window: int = WINDOW, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text: behind a window whose hash is one in ``mean``, between ``least`` and ``most`` bytes apart.

    The hash of a window is a polynomial in its bytes modulo 2 ** 32, taken from running sums, so every
    place costs the same whatever the window's width. A last chunk may be shorter.
    """
    ends, start = [], 0
    rising, falling = _powers()
    limit = np.uint32((1 << 32) // mean - 1)
    found: list[np.ndarray] = []
    for low in range(0, max(len(raw) - window + 1, 0), _SEGMENT):
        some = raw[low : low + _SEGMENT + window - 1].astype(np.uint32) + np.uint32(1)
        sums = np.zeros(len(some) + 1, np.uint32)
        np.cumsum(some * falling[: len(some)], dtype=np.uint32, out=sums[1:])
        hashed = (sums[window:] - sums[:-window]) * rising[window - 1 : len(some)]
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        found.append(np.flatnonzero(hashed <= limit) + low + window)
    for place in (np.concatenate(found).tolist() if found else []):
        while place - start > most:
            start += most
            ends.append(start)
        if place - start >= least:
            ends.append(place)
            start = place
    while len(raw) - start > most:
        start += most
        ends.append(start)
    if start < len(raw):
        ends.append(len(raw))
    return ends


@dataclass(frozen=True, slots=True)
class Summary:
    """What is known of a stretch of UTF-8 bytes; summaries of neighbours add up to that of both."""

    size: int = 0
    lines: int = 0  # line ends
    chars: int = 0  # code points that begin here
    marked: bool = False
    head: bytes = b""
    tail: bytes = b""

    @classmethod
    def of(cls, chunk: bytes) -> Summary:
        raw = np.frombuffer(chunk, np.uint8)
        chars = len(chunk) if chunk.isascii() else int(np.count_nonzero((raw & 0xC0) != 0x80))
        return cls(len(chunk), chunk.count(b"\n"), chars, any(m in chunk for m in _MARKS), chunk[:_OVERLAP], chunk[-_OVERLAP:])

    def __add__(self, other: Summary) -> Summary:
        seam = self.tail + other.head
        marked = self.marked or other.marked or any(m in seam for m in _MARKS)
        head = self.head if self.size >= _OVERLAP else (self.head + other.head)[:_OVERLAP]
        tail = other.tail if other.size >= _OVERLAP else (self.tail + other.tail)[-_OVERLAP:]
        return Summary(self.size + other.size, self.lines + other.lines, self.chars + other.chars, marked, head, tail)


class Chunks:
    """Summaries of the chunks met so far, under their bytes; beyond the bound the memory starts anew."""

    def __init__(self, limit: int = REMEMBERED_BYTES):
        self.known: dict[bytes, Summary] = {}
        self.held, self.limit, self.hits = 0, limit, 0

    def summary(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)  # the dictionary compares the bytes, not only their hash
        if found is None:
            found = Summary.of(chunk)
            if self.held + len(chunk) > self.limit:
                self.known.clear()
                self.held = 0
            self.known[chunk] = found
            self.held += len(chunk)
        else:
            self.hits += 1
        return found


class Cut:
    """A text with the running counts of its chunks' summaries."""

    def __init__(self, text: bytes, chunks: Chunks, **sizes: int):
        self.text = text
        self.ends = borders(np.frombuffer(text, np.uint8), **sizes)
        parts = [chunks.summary(text[a:b]) for a, b in zip([0, *self.ends], self.ends)]
        self.lines = np.cumsum([p.lines for p in parts]) if parts else np.zeros(0, np.int64)
        self.chars = np.cumsum([p.chars for p in parts]) if parts else np.zeros(0, np.int64)
        whole = Summary()
        for p in parts:
            whole = whole + p
        self.whole = whole

    def units(self) -> int:
        """Lines with their ends, and what follows the last line end if there is anything."""
        return self.whole.lines + (1 if self.text and not self.text.endswith(b"\n") else 0)

    def place(self, unit: int) -> tuple[int, int]:
        """Bytes and code points in the first ``unit`` units."""
        if unit <= 0:
            return 0, 0
        if unit > self.whole.lines:
            return len(self.text), self.whole.chars
        k = int(np.searchsorted(self.lines, unit))
        start = self.ends[k - 1] if k else 0
        missing = unit - (int(self.lines[k - 1]) if k else 0)
        chunk, at = self.text[start : self.ends[k]], -1
        for _ in range(missing):
            at = chunk.index(b"\n", at + 1)
        part = Summary.of(chunk[: at + 1])
        return start + at + 1, (int(self.chars[k - 1]) if k else 0) + part.chars


def draws(key: str) -> list[int]:
    """Four numbers of 32 bits from a key."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def form_of(cut: Cut, key: str, rate: int, spm: int) -> tuple[str, int, int]:
    """The form and both cuts in units; ``rate`` and ``spm`` are per cent of all documents and of those transformed."""
    h1, h2, h3, h4 = draws(key)
    n = cut.units()
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not cut.text or cut.whole.marked or h3 % 100 >= rate:
        return "plain", low, high
    return ("spm" if h4 % 100 < spm else "psm"), low, high


def assembled(text: bytes, form: str, low: int, high: int) -> bytes:
    """The three parts, cut at the bytes ``low`` and ``high``, in the order of the form."""
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = _MARKS
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    if form == "spm":
        return b"".join((s, suffix, p, prefix, m, middle))
    return text


def transformed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, out: str = "output"
) -> DataFrame:
    """Add ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and the text ``out`` to every row.

    Cuts, form and order follow from a hash of ``seed`` and the row's id alone: rows of one id are cut
    by the same draws, and reruns agree. A null id draws as ``-``. A null or empty text, and one that
    holds a marker, stays as it is (form ``plain``, null counts); a null text gives an empty output. Texts of
    any length are cut whole, and line ends may be missing or follow each other. All other columns stay;
    those with the names of new ones are replaced. An empty table gives no rows.
    """

    new = T.StructType.fromDDL(f"n long, form string, prefix_chars long, middle_chars long, `{out}` string")
    if text_col in new.names:
        raise ValueError(f"the text column must not be named like a new one: {text_col!r}")
    rest = [c for c in docs.columns if c not in new.names]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")))
    drawn = f"key_{uuid.uuid4().hex}"
    keyed = docs.select(*(F.col(f"`{c}`") for c in rest), key.alias(drawn))

    def run(batches):
        chunks = Chunks()
        for piece in pieces(batches, text_col):
            made = [_row(text or "", key, chunks, rate, spm) for text, key in zip(piece.column(text_col).to_pylist(), piece.column(drawn).to_pylist())]
            arrays = [pa.array(list(x), kind) for x, kind in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), *arrays], names=rest + new.names)

    return keyed.mapInArrow(run, T.StructType([*docs.select(*(F.col(f"`{c}`") for c in rest)).schema.fields, *new.fields]))


def _row(text: str, key: str, chunks: Chunks, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    cut = Cut(text.encode(), chunks)
    form, low, high = form_of(cut, key, rate, spm)
    if form == "plain":
        return cut.units(), form, None, None, text
    (start, before), (end, until) = cut.place(low), cut.place(high)
    return cut.units(), form, before, until - before, assembled(cut.text, form, start, end).decode()


def _between(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and behind a marker that occurs once."""
    return F.substring_index(text, mark, 1), F.substring_index(text, mark, -1)


def restored(form: Column, output: Column) -> Column:
    """The text that a form and an output were made of. Neither parts nor seams can hold a marker, so each is met once."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        head, rest = _between(body, second)
        tail, middle = _between(rest, MIDDLE)
        return head, tail, middle

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)

