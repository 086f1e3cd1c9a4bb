"""Byte-pair encoding by backtracking, for vocabularies whose words end in a suffix.

The longest token at every place of a word comes from one Aho-Corasick pass. A token may follow
another if the merges would have kept the seam between them; where none may, the last choice is
taken back and its next shorter prefix tried, and the place is marked so that it is never tried
again. That gives the same tokens as doing the merges in order. Decoding gathers slices of one
buffer by a table of offsets.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache, lru_cache
from itertools import pairwise
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sheafwork.llm.common import Memory, append, stretches

_END = "\n"  # stands for the suffix; no byte is written as it


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Vocabulary:
    """Tables of a tokenizer file: normal form, word pattern, tokens, merges, pairs and offsets."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not suffix or steps != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("not a vocabulary of lower-case words with an end suffix")
        own = lambda t: t[: -len(suffix)] + _END if t.endswith(suffix) and t != suffix else t
        ids = {own(t): i for t, i in model["vocab"].items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        count = max(names) + 1
        self.size = [0] * count
        self.rank = [-1] * count
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair = ids[own(a)], ids[own(b)]
            token = ids[own(a + b)]
            self.merged[pair] = rank
            self.parts[token] = pair
            self.rank[token] = rank
        self.shorter = [-1] * count
        self.search = ahocorasick.Automaton()
        for text, i in ids.items():
            self.size[i] = len(text)
            self.search.add_word(text, i)
            self.shorter[i] = next((ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in ids), -1)
        self.search.make_automaton()
        shown = [names.get(i, "").encode() + b" " for i in range(count)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.offsets = np.cumsum([0, *map(len, shown)])
        self.letters = byte_letters()
        self.fits, self.words, self.chunks = Memory(self._fits), Memory(self._word), Memory(self._chunk)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging in order leaves the seam between the two tokens open."""
        left, right = pair
        limit = len(self.merged) + 1
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False  # the merge across the seam comes first
            if self.rank[left] > self.rank[right]:
                limit, left = self.rank[left], self.parts[left][1]
            elif self.rank[right] >= 0:
                # Of equal merges the one further left is done first.
                limit, right = self.rank[right] + 1, self.parts[right][0]
            else:
                return True

    def tokens(self, word: str) -> list[int]:
        """Token ids of one word as it stands in the text."""
        plain = word.isascii() and word.isprintable()
        text = (word if plain else "".join([self.letters[b] for b in word.encode()])) + _END
        # Most words need no step back: the longest tokens one after the other already fit.
        out = [token for _, token in self.search.iter_long(text)]
        size, fits = self.size, self.fits
        if sum([size[t] for t in out]) == len(text) and all(map(fits.__getitem__, pairwise(out))):
            return out
        longest = [-1] * len(text)
        for end, token in self.search.iter(text):
            longest[end + 1 - size[token]] = token  # matches come by their ends, so the longest comes last
        out = []
        closed = bytearray(len(text) + 1)
        at, token = 0, longest[0]
        while at < len(text):
            while token >= 0 and (closed[at + size[token]] or out and not fits[out[-1], token]):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < len(text) else -1
            else:
                closed[at] = 1
                if not out:
                    raise ValueError(f"no tokens for {word!r}")
                token = out.pop()
                at -= size[token]
        return out

    def forget(self) -> None:
        """Start a task with empty memories, so that a worker holds one task's words at most."""
        for memory in (self.fits, self.words, self.chunks):
            memory.clear()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of text; its words are found here and their tokens remembered."""
        chunk = unicodedata.normalize("NFC", chunk)
        # A final sigma is lowered like any other: characters are lowered one by one.
        words = self.pattern.findall(chunk.replace("Σ", "σ").lower())
        return b"".join([self.words[w] for w in words])

    def _word(self, word: str) -> bytes:
        return pack(f"<{len(tokens := self.tokens(word))}I", *tokens)

    def _plain(self, text: str) -> bytes:
        # Words never cross white space, so stretches between blanks are looked up whole.
        return b"".join([b"".join(map(self.chunks.__getitem__, part)) for part in stretches(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out, start = [], 0
        for m in self.special_pattern.finditer(text):
            out.append(self._plain(text[start : m.start()]))
            out.append(pack("<I", self.special[m[0]]))
            start = m.end()
        out.append(self._plain(text[start:] if start else text))
        return b"".join(out)

    def decode(self, ids: bytes, step: int = 1 << 18) -> str:
        """The tokens of the ids with a space between, as this kind of vocabulary is decoded."""
        every, out = np.frombuffer(ids, "<u4"), []
        for i in range(0, len(every), step):
            some = every[i : i + step].astype(np.int64)
            sizes = self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(sizes)
            out.append(self.shown[np.repeat(self.offsets[some] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1].decode()


@lru_cache(4)
def vocabulary(raw: bytes) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(raw)


def _shipped(df: DataFrame, path: str):
    """The vocabulary file (a fixed file of a megabyte or two), read here and sent to the workers once."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of a text column, as binary of little-endian unsigned 32-bit integers.

    A null or empty text has none. Texts of any length are read whole, part by part. Rows, their
    other columns and repeated rows stay as they are; a column named like the new one is replaced.
    """
    raw = _shipped(df, path)

    def prepare():
        words = vocabulary(raw.value)
        words.forget()
        return lambda texts: [pa.array([words.encode(t or "") for t in texts.to_pylist()], pa.binary())]

    return append(df, text_col, f"`{ids_col}` binary", prepare, done=lambda: vocabulary(raw.value).forget())


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass, with one vocabulary in each worker."""
    raw = _shipped(df, path)

    def prepare():
        words = vocabulary(raw.value)
        words.forget()

        def work(texts: pa.Array) -> list[pa.Array]:
            ids = [words.encode(t or "") for t in texts.to_pylist()]
            return [pa.array(ids, pa.binary()), pa.array([words.decode(i) for i in ids], pa.string())]

        return work

    return append(df, text_col, f"`{ids_col}` binary, `{decoded_col}` string", prepare, 1 << 20, lambda: vocabulary(raw.value).forget())


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of the ids from :func:`encode`; null or empty ids give an empty text."""
    raw = _shipped(df, path)

    def prepare():
        words = vocabulary(raw.value)
        return lambda ids: [pa.array([words.decode(i or b"") for i in ids.to_pylist()], pa.string())]

    return append(df, ids_col, f"`{text_col}` string", prepare)
