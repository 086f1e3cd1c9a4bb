"""Packing to target token proportions by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. The rounds fill windows of a fixed number of tokens: in each,
a queue's deficit grows by its share of the window and the queue sends packets, stretches of one document, while
the deficit covers them; what is left is carried to the next window. A queue that runs dry leaves its
share to the others in proportion to their weights. As a queue's deficits add up to its share of all tokens dealt
so far, the window of a packet follows from the packet's place in its own queue: no window waits for another, and
the deficits that partitions carry over are known at once. The packets then stand in one line by window, source and
place, which is cut into sequences. Full sequences lie without gaps, so only the end of the line could need padding;
there the rest is cut into powers of two, which need none.
"""

from __future__ import annotations

from collections.abc import Mapping
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sheafwork.llm.bpe import byte_letters
from sheafwork.llm.common import keep, new_folder, pieces, text_or_empty
from sheafwork.llm.ordering import running

SEQUENCE = 2048
#: Tokens of a window, in sequences.
WINDOW = 16
END = 1
#: Weights name at most this many sources; without weights there may be any number.
MOST_SOURCES = 256
#: Words that a task remembers the ids of (twice that for a while), and the longest of them.
REMEMBERED, LONG = 250_000, 64
_TEXT_BYTES = 4 << 20
#: No apostrophe, and nothing that a special token has: a run of such marks behind a word is taken by itself.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Letters below this one are the same in every Unicode version and in normal form.
_LATIN = "\u0250"


class Encoder:
    """Ids of whole texts as the tokenizer of a file gives them, each stretch between blanks encoded once.

    No token crosses a blank or a line end. A stretch of Latin letters goes to the tokenizer's model, in lower case
    and byte by byte, with marks behind it looked up by themselves; any other stretch goes through the whole
    tokenizer. Ids are kept in two bytes where the vocabulary allows it.
    """

    def __init__(self, raw: bytes):
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        letters = byte_letters()
        self.shown = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, ord(_LATIN))}
        self.packs = [Struct(f"<{n}{'H' if self.kind.itemsize == 2 else 'I'}").pack for n in range(LONG + 1)]

    def _found(self, word: str, plain: bool) -> bytes:
        """Ids of a word, from memory or from the model (a plain one) or the tokenizer."""
        ids = self.known.get(word)
        if ids is not None:
            return ids
        ids = self.older.get(word)
        if ids is None:
            numbers = [t.id for t in self.model.tokenize(word.translate(self.shown))] if plain else self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = self.packs[len(numbers)](*numbers) if len(numbers) <= LONG else np.array(numbers, self.kind).tobytes()
        if len(word) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids

    def stretch(self, stretch: str) -> bytes:
        if len(stretch) <= LONG:
            word = stretch.rstrip(_MARKS)
            marks = stretch[len(word) :]
            word = word.lower()
            # Lower case may bring marks that are no letters; they are left to the tokenizer.
            if word.isalpha() and max(word) < _LATIN or not word:
                return (self._found(word, True) if word else b"") + (self._found(marks, False) if marks else b"")
        return self._found(stretch, False)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other with :data:`END` behind each, and where each text's begin."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.list_flatten(parts).dictionary_encode()
        found = [self.stretch(s) for s in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        values = np.frombuffer(b"".join(found), self.kind)
        offsets = np.cumsum([0, *map(len, found)], dtype=np.int64) // self.kind.itemsize
        sizes = np.diff(offsets)[coded.indices.to_numpy()]
        taken = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values)).take(coded.indices).flatten().to_numpy()
        # Tokens before each stretch, so before each text.
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
        starts = np.cumsum(np.concatenate(([0], pc.list_value_length(parts).to_numpy())))
        ends = before[starts]
        rows = np.arange(len(texts) + 1)
        out = np.full(len(taken) + len(texts), END, self.kind)
        at = np.arange(len(taken)) + np.repeat(rows[:-1], np.diff(ends))
        out[at] = taken
        return out, ends + rows


def _long_parts(text: str, limit: int) -> list[str]:
    """A text cut at blanks or line ends into parts of about ``limit`` characters; a part without one stays whole."""
    parts, start = [], 0
    while len(text) - start > limit:
        cut = max(text.rfind(" ", start, start + limit), text.rfind("\n", start, start + limit))
        if cut <= start:
            later = [x for x in (text.find(" ", start + limit), text.find("\n", start + limit)) if x >= 0]
            if not later:
                break
            cut = min(later)
        parts.append(text[start:cut])
        start = cut + 1
    parts.append(text[start:])
    return parts


def encoded(docs: DataFrame, path: str, text_col: str, ids_col: str) -> DataFrame:
    """Replace the text column by its ids, binary of little-endian unsigned integers, :data:`END` behind them, and their number ``n``.

    An id takes the least of two and four bytes that holds all ids of the vocabulary.
    """
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        encoder = Encoder(raw.value)
        for piece in pieces(batches, text_col, _TEXT_BYTES):
            texts = piece.column(text_col)
            if piece.num_rows == 1 and (pc.binary_length(texts)[0].as_py() or 0) > _TEXT_BYTES:
                parts = [encoder.ids(pa.array([p]))[0][:-1] for p in _long_parts(texts[0].as_py(), _TEXT_BYTES)]
                blobs = [np.concatenate([*parts, np.array([END], encoder.kind)]).tobytes()]
            else:
                ids, at = encoder.ids(texts)
                width, data = encoder.kind.itemsize, ids.tobytes()
                blobs = [data[width * a : width * b] for a, b in zip(at.tolist(), at[1:].tolist())]
            sizes = pa.array([len(b) // encoder.kind.itemsize for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), pa.array(blobs, pa.binary()), sizes], names=[*rest, ids_col, "n"])

    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(ids_col, T.BinaryType()), T.StructField("n", T.LongType())])
    return docs.select(*rest, text_or_empty(text_col).alias(text_col)).mapInArrow(run, schema)


def _weights_of(totals: DataFrame, weights: Mapping[str | None, float]) -> dict[str | None, tuple[float, int]]:
    """Weight and tokens of each source that has tokens; every one of them needs a weight above 0."""
    if len(weights) > MOST_SOURCES:
        raise ValueError(f"weights for {len(weights)} sources; at most {MOST_SOURCES}")
    found = {r["source"]: r["tokens"] for r in totals.limit(MOST_SOURCES + 1).collect()}
    missing = [s for s in found if not weights.get(s, 0) > 0]
    if missing:
        raise ValueError(f"sources without a weight above 0: {missing[:5]}")
    return {s: (float(weights[s]), n) for s, n in found.items()}


def dealt_when(sent: Column, own_total: Column, total: Column | int, source: Column, weights: Mapping[str | None, tuple[float, int]] | None) -> Column:
    """Tokens dealt in all rounds by the time a queue's deficits have added up to ``sent`` tokens.

    Without weights a source's share is its own part of all tokens, so all queues end together. With
    weights, a queue that is not yet dry gets its weight's part, and the sum over the queues says how far the rounds are.
    """
    if weights is None:
        return sent.cast("double") * total / own_total
    own = F.lit(None).cast("double")
    for name, (weight, _) in weights.items():
        own = F.when(source.eqNullSafe(F.lit(name)), F.lit(weight)).otherwise(own)
    queues = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(float(n)).alias("n")) for w, n in weights.values()))
    # In one unit of time a queue's deficit grows by its weight, up to all it holds.
    return F.aggregate(queues, F.lit(0.0), lambda done, q: done + F.least(sent / own * q["w"], q["n"]))


def tail(total: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """Begin and length of the sequences behind the last full one: powers of two, the largest first."""
    at, out = total - total % sequence, []
    for bit in range(sequence.bit_length() - 1, -1, -1):
        if (total - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


class Line:
    """Where the sequences of a line of ``total`` tokens begin."""

    def __init__(self, total: int, sequence: int = SEQUENCE):
        self.sequence, self.full = sequence, total // sequence
        self.rest = tail(total, sequence)

    def sequence_at(self, place: int) -> tuple[int, int, int]:
        """Number and begin of the sequence that holds a place of the line, and the begin of the next."""
        if place < self.full * self.sequence:
            number = place // self.sequence
            return number, number * self.sequence, (number + 1) * self.sequence
        for i, (begin, size) in enumerate(self.rest):
            if begin <= place < begin + size:
                return self.full + i, begin, begin + size
        raise ValueError(f"place {place} is behind the line")

    def pieces(self, packets: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """``(start, length, sequence_id, offset, window)`` of packets ``(start, length, place, window)``.

        Packets of one window that go on in one sequence are one piece.
        """
        out: list[list[int]] = []
        for start, length, place, window in sorted(packets):
            while length:
                number, begin, end = self.sequence_at(place)
                some = min(length, end - place)
                last = out[-1] if out else None
                if last and last[0] + last[1] == start and last[2] == number and last[3] + last[1] == place - begin and last[4] == window:
                    last[1] += some
                else:
                    out.append([start, some, number, place - begin, window])
                start, length, place = start + some, length - some, place + some
        return [tuple(x) for x in out]


def packed(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Mapping[str | None, float] | None = None,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``sequence`` tokens (a power of two).

    One row for each piece: id, source, ``start`` (tokens of its document before it), ``length``, ``ids`` (binary,
    little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` and ``window``.
    Every token is in one piece. ``weights`` are the target proportions, one for each source
    (at most 256); without them a source's share of every window is its part of all tokens. In every
    window, the tokens sent of a source so far lie within a packet (``sequence`` tokens) of its share.

    A null or empty text is one token, the end. Null sources are a queue of their own, and rows of one id are
    documents of their own, in the order of their ids' digests. A document of any length is cut into packets and
    may spread over many sequences. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    if sequence & (sequence - 1) or sequence < 1:
        raise ValueError("a sequence has a power of two of tokens")
    spark = docs.sparkSession
    folder = new_folder(spark)
    plain = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    tokens = encoded(plain, path, "text", "ids")
    # The number is stored with the row, so it is the same whenever the table is read.
    tokens = keep(tokens.select(F.monotonically_increasing_id().alias("row"), "*", F.sha2("ids", 256).alias("digest")), folder, "tokens")
    queued = running(tokens.select("row", "source", "id", "digest", "n"), "source", ["id", "digest", "row"], F.col("n"), folder, "queues")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    found = None
    if weights is not None:
        found = _weights_of(tokens.groupBy("source").agg(F.sum("n").alias("tokens")), weights)
    cuts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(sequence).cast("long"))
    packets = queued.select("row", "source", "n", "inside", F.col("total").alias("own_total"), F.explode(cuts).alias("start"))
    packets = packets.withColumn("length", F.least(F.lit(sequence).cast("long"), F.col("n") - F.col("start")))
    due = dealt_when(F.col("inside") + F.col("start") + F.col("length"), F.col("own_total"), total, F.col("source"), found)
    # The deficit covers a packet in the window in which the queue's share reaches the packet's last token.
    packets = packets.withColumn("window", F.greatest(F.ceil(due / (window * sequence)) - 1, F.lit(0)).cast("long")).withColumn("at", F.col("inside") + F.col("start"))
    line = running(packets.select("row", "source", "start", "length", "window", "at"), "window", ["source", "at"], F.col("length"), folder, "line")
    placed = line.groupBy("row").agg(F.collect_list(F.struct("start", "length", F.col("before").alias("place"), "window")).alias("packets"))
    joined = tokens.select("row", "id", "source", "ids", "n").join(placed, "row").drop("row")
    schema = T.StructType.fromDDL(
        "id string, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long"
    )
    schema["id"].dataType = tokens.schema["id"].dataType
    where = Line(total, sequence)

    def run(batches):
        for piece in pieces(batches, "ids", _TEXT_BYTES):
            own, columns = [], [[] for _ in range(7)]
            for i, (ids, n, packets) in enumerate(zip(piece.column("ids").to_pylist(), piece.column("n").to_pylist(), piece.column("packets").to_pylist())):
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                for start, length, number, offset, turn in where.pieces([(p["start"], p["length"], p["place"], p["window"]) for p in packets]):
                    own.append(i)
                    for column, value in zip(columns, (start, length, ids[4 * start : 4 * (start + length)], n, number, offset, turn)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4)
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            rows = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("id").take(rows), piece.column("source").take(rows), *made], schema=_arrow(piece, made))

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _arrow(piece: pa.RecordBatch, made: list[pa.Array]) -> pa.Schema:
    names = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window")
    return pa.schema([piece.schema.field("id"), piece.schema.field("source"), *(pa.field(n, a.type) for n, a in zip(names, made))])


def ids_crc32(ids: Column) -> Column:
    """CRC-32 of a piece's ids."""
    return F.crc32(ids)


def ledger(pieces_of: DataFrame) -> DataFrame:
    """Tokens that every window sent of every source, for the account of shares and deficits."""
    return pieces_of.groupBy("window", "source").agg(F.sum("length").alias("tokens"))
