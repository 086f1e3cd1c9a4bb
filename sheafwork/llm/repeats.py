"""Long passages that repeat across documents, from common-prefix interval trees of suffix arrays.

Every window of ``LENGTH`` bytes has an anchor: the smallest hash among the ``GRAM``-byte strings in it.
Equal windows have equal anchors, so only anchors that occur in several documents can lie in a
repeat. For these, the bytes that the anchor's windows cover are brought together by anchor. There the
suffixes that start at the anchors are sorted, a stack scan over the common prefixes of neighbours gives
the tree of intervals, and within each interval the bytes to the left are sorted and scanned in
the same way: where left extensions part, a maximal repeat ends. Every repeat lists all its members;
those in a document with a larger id than the smallest member's are removed.

Documents are handled in blocks of some megabytes of text, as many as the table's size asks for. A block
sends an anchor, and equal bytes around it, once. The anchor's own bytes stay behind: all 64 bits of
their hash travel instead, and members must agree on the bytes around it besides. An anchor that many
blocks have is split up by the bytes beside it: the places that it can have in a window are cut into ``PARTS``, and the
windows of one part have most of their bytes in common, by which they are dealt. So a task gathers of one passage what
differs in the few bytes ahead of and behind these, and each of that once for each block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import buffer_of, hash_between, keep, mix, new_folder, running_sums, text_or_empty

LENGTH = 50
GRAM = 28
#: Bytes of text in a block, on the average.
BLOCK_BYTES = 8 << 20
#: An anchor in more blocks than this is split up, into so many parts at most.
HOT = 64
PARTS = 4
_SEGMENT = 1 << 20
_ROWS = 1 << 14
_LOW = (1 << 24) - 1
#: Bits of a hash that stay behind where it is only asked for.
_UNASKED = 32
_LAST_ID = 2**63 - 1


def in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a block's texts by id, those of one id by digest, however they arrive."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        digests = [hashlib.sha256(t).digest() for t in table.column("text").cast(pa.binary()).to_pylist()]
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], digests[i])))
    table = table.take(pa.array(order))
    return (ids[order], *buffer_of(table.column("text")))


class Block:
    """The texts of one block in a fixed order, and their anchored runs of windows."""

    def __init__(self, table: pa.Table, length: int = LENGTH, gram: int = GRAM):
        self.ids, self.raw, self.at = in_order(table)
        self.length, self.gram = length, gram
        found = [self._runs(i) for i in range(0, max(len(self.raw) - length + 1, 0), _SEGMENT)]
        #: Of each run of windows with one anchor: the anchor, first and last window, row, hash of the anchor's bytes.
        self.anchor, self.first, self.last, self.row = (np.concatenate(x) for x in list(zip(*found))[:4]) if found else (np.zeros(0, np.int64),) * 4
        self.hash = np.concatenate([x[4] for x in found]) if found else np.zeros(0, np.uint64)

    def _runs(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs of a segment of windows from ``start`` on; a run that goes on in the next one is cut.

        The smallest hash wins, of equal ones the leftmost; the hash's upper bits and the place are
        compared as one number.
        """
        width = self.length - self.gram + 1
        stop = min(start + _SEGMENT, len(self.raw) - self.length + 1)
        sums = running_sums(self.raw[start : stop + self.length - 1])
        begin = np.arange(stop - start + width - 1)
        hashed = hash_between(sums, begin, begin + self.gram)
        packed = (hashed & ~np.uint64(_LOW)) | begin.astype(np.uint64)
        # A string that runs over the end of its text must not become an anchor of the text's windows; such
        # windows run over the end too and are dropped later.
        reach = 1
        least = packed
        while reach * 2 <= width:
            least = np.minimum(least[: len(least) - reach], least[reach:])
            reach *= 2
        rest = width - reach
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        p, window = (least & np.uint64(_LOW)).astype(np.int64), np.arange(start, stop)
        row = np.searchsorted(self.at, window, side="right") - 1
        inside = window + self.length <= self.at[row + 1]
        p, window, row = p[inside], window[inside], row[inside]
        opens = np.ones(len(p) + 1, bool)
        opens[1:-1] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
        cut = np.flatnonzero(opens)
        first, last = cut[:-1], cut[1:] - 1
        return p[first] + start, window[first], window[last], row[first], hashed[p[first]]


class Packed:
    """Columns of numbers as one compressed binary: byte by byte, so that equal high bytes cost nothing.

    Where keys are only asked for, they travel as the upper 32 bits of a hash, within a bucket that depends on
    all bits and whose number of keys does not grow with the table: one in some thousands coincides with another.
    Such keys only bring bytes together that are compared.
    """

    def __init__(self, **kinds: str):
        self.kinds = {name: np.dtype(kind if kind != "key" else "u8") for name, kind in kinds.items()}
        self.skip = {name: _UNASKED // 8 if kind == "key" else 0 for name, kind in kinds.items()}

    def pack(self, columns: list[np.ndarray], tail: bytes = b"") -> bytes:
        parts = []
        for (name, kind), column in zip(self.kinds.items(), columns):
            planes = np.ascontiguousarray(column.astype(kind)).view(np.uint8).reshape(len(column), kind.itemsize)
            parts.append(planes[:, self.skip[name] :].T.tobytes())
        return zstandard.compress(b"".join(parts) + tail, 3)

    def unpack(self, rows: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """The columns of all rows together, the entries in each row, and the bytes behind the columns."""
        found: dict[str, list] = {name: [np.zeros(0, kind)] for name, kind in self.kinds.items()}
        tails = []
        counts = rows.column("n").to_numpy().astype(np.int64)
        for n, blob in zip(counts.tolist(), rows.column("data").to_pylist()):
            raw, at = np.frombuffer(zstandard.decompress(blob), np.uint8), 0
            for name, kind in self.kinds.items():
                width = kind.itemsize - self.skip[name]
                planes = np.zeros((n, kind.itemsize), np.uint8)
                planes[:, self.skip[name] :] = raw[at : at + n * width].reshape(width, n).T
                found[name].append(planes.view(kind).ravel())
                at += n * width
            tails.append(raw[at:])
        return {name: np.concatenate(x) for name, x in found.items()}, counts, np.concatenate(tails) if tails else np.zeros(0, np.uint8)


KEYS = Packed(key="key", mark="u1")
SPANS = Packed(row="i4", start="i4", end="i4")
ENTRIES = Packed(key="u8", id="i8", row="i4", start="i4", left="u1", n="u1")
ASKED = "bucket long, block long, n long, data binary"
TOLD = "bucket long, block long, kind int, n long, data binary"


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key % np.uint64(buckets)).astype(np.int64)


def _short(key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The key as it arrives, with its bucket in the bits that stay behind."""
    low = np.uint64((1 << _UNASKED) - 1)
    return (key & ~low) | (bucket.astype(np.uint64) & low)


def _starts(sorted_values: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The different values, and from where to where each stands."""
    met, start = np.unique(sorted_values, return_index=True)
    return met, list(zip(start.tolist(), [*start[1:].tolist(), len(sorted_values)]))


def _rows(schema: str, lines: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))]
    return pa.table([pa.array([line[i] for line in lines], kind) for i, (_, kind) in enumerate(fields)], schema=pa.schema(fields))


def ask(table: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    """A block's distinct anchors by bucket, and whether several of its documents have them."""
    block, own = Block(table, length, gram), table.column("block")[0].as_py()
    ids = block.ids[block.row]
    order = np.lexsort((ids, block.hash))
    h, ids = block.hash[order], ids[order]
    opens = np.ones(len(h), bool)
    opens[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(opens)
    last = np.concatenate((first[1:], [len(h)])) - 1 if len(h) else first
    several = (ids[first] != ids[last]).astype(np.uint8)
    h, bucket = h[first], _bucket(h[first], buckets)
    order = np.lexsort((h, bucket))
    h, several, bucket = h[order], several[order], bucket[order]
    return _rows(ASKED, [(b, own, hi - lo, KEYS.pack([h[lo:hi], several[lo:hi]])) for b, (lo, hi) in zip(*map(list, _starts(bucket)))])


def answer(table: pa.Table, hot: int) -> pa.Table:
    """To each block its anchors that other blocks have too, marked where these are many."""
    got, counts, _ = KEYS.unpack(table)
    block = np.repeat(table.column("block").to_numpy(), counts)
    _, group, n = np.unique(got["key"], return_inverse=True, return_counts=True)
    shared = n[group] > 1
    h, block, many = got["key"][shared], block[shared], n[group][shared] > hot
    order = np.lexsort((h, block))
    h, block, many = h[order], block[order], many[order]
    own = table.column("bucket")[0].as_py()
    return _rows(TOLD, [(own, b, 0, hi - lo, KEYS.pack([h[lo:hi], many[lo:hi]])) for b, (lo, hi) in zip(*map(list, _starts(block)))])


def _matrix(raw: np.ndarray, start: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Stretches of bytes as rows of a matrix, with zeros behind their ends."""
    out = np.zeros((len(start), width), np.uint8)
    for i in range(0, len(start), _ROWS):
        at = np.minimum(start[i : i + _ROWS, None] + np.arange(width), max(len(raw) - 1, 0))
        out[i : i + _ROWS] = np.where(np.arange(width) < n[i : i + _ROWS, None], raw[at], 0)
    return out


def _looks(bytes_: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a matrix."""
    wide = np.zeros((len(bytes_), -(-bytes_.shape[1] // 8) * 8), np.uint8)
    wide[:, : bytes_.shape[1]] = bytes_
    total = np.zeros(len(wide), np.uint64)
    for column in np.ascontiguousarray(wide).view(np.uint64).T:
        total = mix(total ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return mix(total)


def split_up(block: Block, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the runs in parts by the anchor's place in the window: run, first and last window, key.

    All windows of a part have certain bytes around the anchor; their hash is the part's key. Equal windows have
    the anchor at one place, so they are in parts of one key.
    """
    most = block.length - block.gram
    step = -(-(most + 1) // PARTS)
    found = []
    for low in range(0, most + 1, step):
        high = min(low + step - 1, most)
        anchor = block.anchor[runs]
        first, last = np.maximum(block.first[runs], anchor - high), np.minimum(block.last[runs], anchor - low)
        some = first <= last
        size = block.length - (high - low)
        core = _looks(_matrix(block.raw, anchor[some] - low, np.full(int(some.sum()), size), size))
        found.append((runs[some], first[some], last[some], mix(core + np.uint64(low))))
    return tuple(np.concatenate(x) for x in zip(*found))


def send(texts: pa.Table, told: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    """The bytes around a block's shared anchors, equal ones once, and the spans that the block settles itself.

    An entry is a stretch of a text, without its anchor's bytes, and the anchor's place in it. Of equal stretches the one with
    the smallest id speaks for all with larger ids: these are spans to remove whatever other blocks say.
    """
    if not texts.num_rows:
        return _rows(TOLD, [])
    block, own = Block(texts, length, gram), texts.column("block")[0].as_py()
    own_id = block.ids[block.row]
    copies = told.filter(pc.equal(told.column("kind"), 2))
    told = told.filter(pc.equal(told.column("kind"), 0))
    got, counts, _ = KEYS.unpack(told)
    h, many = _short(got["key"], np.repeat(told.column("bucket").to_numpy(), counts)), got["mark"]
    order = np.argsort(h)
    h, many = h[order], many[order]
    asked = _short(block.hash, _bucket(block.hash, buckets))
    at = np.searchsorted(h, asked)
    known = (at < len(h)) & (h[np.minimum(at, max(len(h) - 1, 0))] == asked) if len(h) else np.zeros(len(at), bool)
    hot = known & (many[np.minimum(at, max(len(h) - 1, 0))] > 0) if len(h) else known
    # Anchors that only this block has, but in several of its documents.
    order = np.lexsort((own_id, block.hash))
    same = np.zeros(len(order), bool)
    same[1:] = block.hash[order][1:] == block.hash[order][:-1]
    group = np.cumsum(~same) - 1
    low, high = np.full(len(order), _LAST_ID), np.full(len(order), -_LAST_ID)
    np.minimum.at(low, group, own_id[order])
    np.maximum.at(high, group, own_id[order])
    local = np.zeros(len(order), bool)
    local[order] = (low != high)[group]
    # A copy of a document with a smaller id goes as a whole and has nothing to ask.
    copied = np.isin(block.ids, np.concatenate([np.frombuffer(x, np.int64) for x in copies.column("data").to_pylist()] or [np.zeros(0, np.int64)]))
    cold = np.flatnonzero((known | local) & ~hot & ~copied[block.row])
    start, n, left = block.first[cold], block.last[cold] - block.first[cold] + length, block.anchor[cold] - block.first[cold]
    key, row = block.hash[cold], block.row[cold]
    runs = np.flatnonzero(hot & ~copied[block.row])
    if len(runs):
        each, first, last, parts = split_up(block, runs)
        start = np.concatenate((start, first))
        n = np.concatenate((n, last - first + length))
        left = np.concatenate((left, block.anchor[each] - first))
        key = np.concatenate((key, parts))
        row = np.concatenate((row, block.row[each]))
    ids = block.ids[row]
    bytes_ = _matrix(block.raw, start, n, 2 * length)
    looks = _looks(bytes_) + left.astype(np.uint64)
    order = np.lexsort((ids, looks, key))
    start, n, left, key, row, ids, looks, bytes_ = (x[order] for x in (start, n, left, key, row, ids, looks, bytes_))
    alike = np.zeros(len(key), bool)
    alike[1:] = (key[1:] == key[:-1]) & (looks[1:] == looks[:-1]) & (n[1:] == n[:-1]) & (left[1:] == left[:-1]) & (bytes_[1:] == bytes_[:-1]).all(1)
    speaker = np.maximum.accumulate(np.where(alike, 0, np.arange(len(key)))) if len(key) else np.zeros(0, np.int64)
    settled = ids > ids[speaker] if len(key) else alike
    mine = start - block.at[row]
    whole = np.flatnonzero(copied & (np.diff(block.at) >= length))
    spans = _merged(
        np.concatenate((row[settled], whole)),
        np.concatenate((mine[settled], np.zeros(len(whole), np.int64))),
        np.concatenate((mine[settled] + n[settled], np.diff(block.at)[whole])),
    )
    keep = np.flatnonzero(~settled)
    bucket = _bucket(key[keep], buckets)
    # In the order of the text within a bucket: neighbours share their high bytes.
    order = np.lexsort((mine[keep], row[keep], bucket))
    keep, bucket = keep[order], bucket[order]
    place = np.arange(2 * length)
    solid = (place < n[:, None]) & ((place < left[:, None]) | (place >= left[:, None] + gram))
    lines = []
    for b, (lo, hi) in zip(*map(list, _starts(bucket))):
        e = keep[lo:hi]
        lines.append((b, own, 0, hi - lo, ENTRIES.pack([key[e], ids[e], row[e], mine[e], left[e], n[e]], bytes_[e][solid[e]].tobytes())))
    # Settled spans travel with the rest, in a bucket of the block's own.
    return _rows(TOLD, [*lines, (own % buckets, own, 1, len(spans[0]), SPANS.pack(list(spans)))])


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by row and start, those that meet as one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
    shift = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    opens = np.ones(len(row), bool)
    opens[1:] = (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.concatenate((first[1:], [len(row)])) - 1
    return row[first].astype(np.int32), start[first].astype(np.int32), (reach[last] - shift[last]).astype(np.int32)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def intervals(prefixes: list[int]) -> list[tuple[int, int, int]]:
    """``(depth, first, last)`` of every interval of the tree, by a stack scan over neighbours' common prefixes.

    ``prefixes[i]`` is the common prefix of the sorted strings i and i + 1. Intervals of one string are left out.
    """
    out, stack = [], [(0, 0)]
    for i, depth in enumerate([*prefixes, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            out.append((top, first, i))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
    return out


def maximal_repeats(members: list[tuple[bytes, bytes]], length: int) -> list[tuple[int, int, list[int]]]:
    """Maximal repeats through a common anchor: ``(left, right, members)`` with ``left + right >= length``.

    A member is its bytes before the anchor, reversed, and those behind it. The members of an
    interval agree on ``right`` bytes behind the anchor and differ then; among them, intervals of
    the left sides agree on ``left`` bytes before it and differ ahead of these.
    """
    order = sorted(range(len(members)), key=lambda i: members[i][1])
    found = []
    for right, first, last in _side_intervals([members[i][1] for i in order]):
        side = sorted(order[first : last + 1], key=lambda i: members[i][0])
        for left, low, high in _side_intervals([members[i][0] for i in side]):
            if left + right >= length:
                found.append((left, right, side[low : high + 1]))
    return found


def _side_intervals(sides: list[bytes]) -> list[tuple[int, int, int]]:
    """Intervals of sorted sides, with that of all of them where they share nothing."""
    prefixes = [common(a, b) for a, b in zip(sides, sides[1:])]
    return intervals(prefixes) + ([(0, 0, len(sides) - 1)] if min(prefixes) == 0 else [])


def settle(table: pa.Table, length: int, gram: int) -> pa.Table:
    """Spans to remove, by block, from all entries of a bucket."""
    sent = table.filter(pc.equal(table.column("kind"), 0))
    passed = table.filter(pc.equal(table.column("kind"), 1))
    got, counts, data = ENTRIES.unpack(sent)
    key, ids, row, start = got["key"], got["id"], got["row"], got["start"]
    left, n = got["left"].astype(int), got["n"].astype(int)
    block = np.repeat(sent.column("block").to_numpy(), counts)
    at = np.cumsum(n - gram) - (n - gram)
    order = np.lexsort((row, block, ids, key))
    key, ids, row, start, left, n, block, at = (x[order] for x in (key, ids, row, start, left, n, block, at))
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, int)
    # A key of one document holds no repeat across documents.
    low, high = cuts[:-1], cuts[1:]
    several = ids[low] != ids[high - 1] if len(low) else np.zeros(0, bool)
    low, high = low[several], high[several]
    use = np.repeat(low, high - low) + np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    key, ids, row, start, left, n, block, at = (x[use] for x in (key, ids, row, start, left, n, block, at))
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(key):
        sizes = high - low
        group = np.repeat(np.arange(len(sizes)), sizes)
        head = np.cumsum(sizes) - sizes
        right_side = _matrix(data, at + left, n - left - gram, length)
        left_side = _mirrored(data, at, left, length)
        # Where all members of a key meet in one interval, its depth to both sides is the least agreement with the first.
        first = head[group]
        right = gram + _agree(right_side, right_side[first], np.minimum(n - left, (n - left)[first]) - gram)
        before = _agree(left_side, left_side[first], np.minimum(left, left[first]))
        # Two members, or members that agree wholly with the first: one interval each way.
        whole = (right == n - left) & (before == left) & (n == n[first]) & (left == left[first])
        plain = np.ones(len(sizes), bool)
        np.logical_and.at(plain, group, whole)
        pair = sizes == 2
        easy = (plain | pair)[group] & (ids > ids[first]) & (before + right >= length)
        anchor = start + left
        spans.append((np.flatnonzero(easy), (anchor - before)[easy], (anchor + right)[easy]))
        for g in np.flatnonzero(~(plain | pair)):
            spans.append(_scan(np.arange(head[g], head[g] + sizes[g]), data, at, left, n - gram, ids, anchor, length, gram))
    entry, lo, hi = (np.concatenate(x).astype(np.int64) for x in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 3
    order = np.argsort(block[entry], kind="stable")
    entry, lo, hi = entry[order], lo[order], hi[order]
    lines = []
    for b, (i, j) in zip(*map(list, _starts(block[entry]))):
        merged = _merged(row[entry[i:j]].astype(np.int64), lo[i:j], hi[i:j])
        lines.append((-1, b, 1, len(merged[0]), SPANS.pack(list(merged))))
    lines += [(-1, line["block"], 1, line["n"], line["data"]) for line in passed.to_pylist()]
    return _rows(TOLD, lines)


def _mirrored(data: np.ndarray, at: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """The bytes before the anchors from right to left, with zeros behind."""
    out, back = np.zeros((len(at), width), np.uint8), np.arange(width)
    for i in range(0, len(at), _ROWS):
        place = np.maximum((at[i : i + _ROWS] + left[i : i + _ROWS] - 1)[:, None] - back, 0)
        out[i : i + _ROWS] = np.where(back < left[i : i + _ROWS, None], data[place], 0)
    return out


def _agree(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    differ = a != b
    length = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(length, most)


def _scan(entries, data, at, left, n, ids, anchor, length, gram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of one key's entries by the interval trees of their sides; all have the anchor between these."""
    by_look: dict[tuple[bytes, bytes], list[int]] = {}
    for e in entries.tolist():
        stretch = data[at[e] : at[e] + n[e]].tobytes()
        by_look.setdefault((stretch[: left[e]][::-1], stretch[left[e] :]), []).append(e)
    looks = list(by_look)
    owners = [by_look[x] for x in looks]
    smallest = [min(ids[e] for e in own) for own in owners]
    spans = [(len(a), len(b), [i]) for i, (a, b) in enumerate(looks) if len(owners[i]) > 1] + maximal_repeats(looks, length - gram)
    out = []
    for before, after, members in spans:
        least = min(smallest[i] for i in members)
        out += [(e, anchor[e] - before, anchor[e] + gram + after) for i in members for e in owners[i] if ids[e] > least]
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _mask(raw: np.ndarray, at: np.ndarray, told: pa.Table) -> np.ndarray:
    """True for each byte to remove."""
    got = SPANS.unpack(told)[0]
    row, lo, hi = (got[c].astype(np.int64) for c in ("row", "start", "end"))
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, at[row] + lo, 1)
    np.add.at(edge, at[row] + hi, -1)
    return np.cumsum(edge, out=edge)[:-1] > 0


def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
    """``id, spans, kept``: the removed runs of each text as (start, end) byte places, and the bytes left."""
    ids, raw, at = in_order(texts)
    gone = _mask(raw, at, told)
    spans, kept = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = gone[a:b]
        turns = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        spans.append([{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()])
        kept.append(raw[a:b][~own].tobytes())
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.Table.from_arrays([pa.array(ids), pa.array(np.diff(at)), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def _copies(texts: DataFrame, folder: str) -> DataFrame:
    """To each block the ids of its texts that a document with a smaller id has whole."""
    digests = keep(texts.select("block", "id", F.sha2("text", 256).alias("sha")), folder, "digests")
    firsts = keep(digests.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1"), folder, "firsts")
    # Rows of one id may hold other texts too: an id goes whole only if all its texts do.
    held = digests.join(firsts, "sha", "left").groupBy("block", "id").agg(F.max(F.coalesce("first", "id")).alias("first"))

    def packed(table: pa.Table) -> pa.Table:
        ids = np.sort(table.column("id").to_numpy())
        return _rows(TOLD, [(-1, table.column("block")[0].as_py(), 2, len(ids), ids.tobytes())])

    return held.where("first < id").groupBy("block").applyInArrow(packed, TOLD)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row for each input row: id, ``n_bytes``, ``spans`` (removed runs, in bytes) and ``kept`` (bytes).

    A byte is removed if it is covered by ``length`` bytes that also start in a document with a smaller id.
    Null texts are empty; texts shorter than ``length`` bytes stay whole. Ids are integers; a null id
    counts as the largest. Rows of one id are one document and don't remove from each other. An empty
    table gives no rows; repeated rows give repeated results.
    """
    if not 0 < gram < length <= 100:
        raise ValueError("the anchors must be shorter than the windows, of 100 bytes at most")
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col!r} must be a column of integers")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID))
    texts = docs.select(ids.alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("long").alias("block"), "id", "text")
    # The texts are shuffled by block once; Spark uses that shuffle in all three steps that read them.
    blocks = texts.groupBy("block")
    asked = blocks.applyInArrow(lambda t: ask(t, n, length, gram), ASKED)
    told = asked.groupBy("bucket").applyInArrow(lambda t: answer(t, hot), TOLD)
    told = told.unionByName(_copies(texts, new_folder(docs.sparkSession)))
    sent = blocks.cogroup(told.groupBy("block")).applyInArrow(lambda t, r: send(t, r, n, length, gram), TOLD)
    settled = sent.groupBy("bucket").applyInArrow(lambda t: settle(t, length, gram), TOLD)
    schema = "id long, n_bytes long, spans array<struct<start long, end long>>, kept binary"
    done = blocks.cogroup(settled.groupBy("block")).applyInArrow(finish, schema)
    kind = docs.schema[id_col].dataType
    return done.select(F.when(F.col("id") != _LAST_ID, F.col("id")).cast(kind).alias(id_col), "n_bytes", "spans", "kept")
