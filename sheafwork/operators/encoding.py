"""Corpus vocabularies, and token <-> id translation of whole columns.

Translation has two tiers, the same for a vocabulary of any size. Ids are ordered by count, so
the entries with the smallest ids, the head, hold every hot token. The head is bounded in rows and
in bytes of each token; it is broadcast, kept as Arrow arrays in each worker, and looked up in
the row where the tokens were read. What a row has besides, its different tokens in order, is asked
from the entries behind the head, the tail; until then the row holds numbers in place of its tokens. Rows ask
in chunks: a chunk joins each of its tokens with the tail once, however many rows have it, and its answers go
back to the rows by a digest of what they asked. A vocabulary without a tail has nothing to join, so a document
stays one row and is never shuffled. Rows with the same missing tokens share the answer, so
repeated ids or rows give the same result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions import arrays
from sheafwork.functions.lists import byte_lengths, ends, flat, packed, regroup, string_hashes, unpacked
from sheafwork.functions.text import ColumnFn, clean_decoded, words
from sheafwork.operators.sampling import running_offsets
from sheafwork.sources.tables import shared_dir

# Special tokens, which take the first ids in this order.
SPECIALS = ("<pad>", "<unk>", "<bos>", "<sep>", "<eos>")
PAD, UNK, BOS, SEP, EOS = range(len(SPECIALS))

#: The head has ids below ``HEAD_ROWS`` and tokens of at most ``HEAD_TOKEN_BYTES``: 32 MB of text, whatever the corpus.
HEAD_ROWS = 1 << 19
HEAD_TOKEN_BYTES = 64

#: Elements that the rows of a chunk ask for at most, if it is not a single row; and answers that a task gathers at once.
CHUNK, GATHERED = 1 << 21, 1 << 20


def tokenize(df: DataFrame, col: str = "text", out: str = "tokens", tokenizer: ColumnFn = words) -> DataFrame:
    return df.withColumn(out, tokenizer(F.col(col)))


def token_counts(df: DataFrame, cols: Sequence[str], tokenizer: ColumnFn = words) -> DataFrame:
    """(token, n) over the given text columns; counts combine before the shuffle."""
    pieces = F.concat(*[F.coalesce(tokenizer(F.col(c)), F.array().cast("array<string>")) for c in cols])
    return df.select(F.explode(pieces).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def build_vocab(
    df: DataFrame,
    cols: Sequence[str] = ("text",),
    max_size: int | None = None,
    min_count: int = 1,
    specials: Sequence[str] = SPECIALS,
    tokenizer: ColumnFn = words,
) -> DataFrame:
    """(token, id): specials first, then tokens by count descending and token ascending.

    ``max_size`` bounds the result, specials included; None keeps the whole vocabulary. Counted tokens are
    written once to the shared folder, in ranges of that order which Spark cuts at sampled keys. A range is
    numbered by one task, behind the sizes of the earlier ranges (one row each). So no task holds more than a range,
    however many tokens share a count or their first letters.
    """
    spark, order = df.sparkSession, (F.desc("n"), F.asc("token"))
    counts = token_counts(df, cols, tokenizer).where((F.col("n") >= min_count) & ~F.col("token").isin(list(specials)))
    path = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.schema("token string, n bigint, part int").parquet(path)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    offsets = running_offsets(ranged, "part", F.lit(1)).select("part", "offset")
    rank = F.col("offset") + F.col("inside")
    numbered = ranged.withColumn("inside", inside).join(F.broadcast(offsets), "part")
    learned = numbered.select("token", (rank + (len(specials) - 1)).cast("int").alias("id"))
    if max_size is not None:
        learned = learned.where(F.col("id") < max_size)
    rows = [(token, i) for i, token in enumerate(specials)]
    return spark.createDataFrame(rows, "token string, id int").unionByName(learned)


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count("*").alias("vocab_size"))


def ensure_pad_token(tokenizers: DataFrame) -> DataFrame:
    """A tokenizer without a pad id pads with its end-of-sequence id."""
    return tokenizers.withColumn("pad_id", F.coalesce("pad_id", "eos_id"))


class Head:
    """The head's entries on the executors, as Arrow arrays; a worker orders their hashes once, however many batches and columns ask."""

    ready: dict[str, Head] = {}

    def __init__(self, entries: pa.RecordBatch):
        self.tokens, self.ids = entries.column("token"), entries.column("id")
        # Of equal tokens or ids the last one is found.
        places = np.full(int(pc.max(self.ids).as_py() or 0) + 1 if len(self.ids) else 0, -1, np.int32)
        places[self.ids.to_numpy()] = np.arange(len(entries))
        self.places = places
        self.longest = int(byte_lengths(self.tokens).max(initial=0))
        hashes = string_hashes(self.tokens, self.longest)
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    @classmethod
    def of(cls, name: str, entries) -> Head:
        if name not in cls.ready:
            if len(cls.ready) >= 2:
                cls.ready.pop(next(iter(cls.ready)))
            cls.ready[name] = cls(entries.value)
        return cls.ready[name]

    def targets(self, way: str) -> pa.Array:
        return self.ids if way == "encode" else self.tokens

    def find(self, way: str, sources: pa.Array) -> np.ndarray:
        """Places of different sources among the entries, -1 where the head has none."""
        if way == "encode":
            return self._find_tokens(sources)
        numbers = sources.to_numpy(zero_copy_only=False).astype(np.int64)
        inside = (numbers >= 0) & (numbers < len(self.places))
        at = np.full(len(numbers), -1, np.int32)
        at[inside] = self.places[numbers[inside]]
        return at

    def _find_tokens(self, sources: pa.Array) -> np.ndarray:
        """By hashes, then by the tokens themselves; only where equal hashes stand for different tokens, all tokens are asked."""
        at = np.full(len(sources), -1, np.int32)
        asked = string_hashes(sources, self.longest)
        near = np.searchsorted(self.hashes, asked, side="right") - 1
        hit = np.flatnonzero((near >= 0) & (self.hashes[near] == asked)) if len(self.hashes) else near[:0]
        found, wanted = self.order[near[hit]], sources.take(pa.array(hit))
        same = pc.equal(self.tokens.take(pa.array(found)).cast(wanted.type), wanted).to_numpy(zero_copy_only=False)
        at[hit[same]] = found[same]
        if not same.all():
            back = pc.index_in(wanted.filter(pa.array(~same)), self.tokens[::-1])
            at[hit[~same]] = pc.fill_null(pc.subtract(len(self.tokens) - 1, back), -1).to_numpy(zero_copy_only=False)
        return at

    def look_up(self, way: str, sources: pa.Array, default: int | None) -> pa.Array:
        """Targets of sources, ``default`` (or null) where the head has none; every different source is looked up once."""
        coded = sources.dictionary_encode()
        at = self.find(way, coded.dictionary)
        out = self.targets(way).take(pa.array(at, mask=at < 0)).take(coded.indices)
        return out if default is None else pc.fill_null(out, pa.scalar(default, out.type))


@dataclass(frozen=True)
class Codec:
    """A vocabulary in two tiers: the head as a broadcast, the tail as a stored table (None if it has no rows)."""

    name: str
    head: object  # Broadcast[pa.RecordBatch] with token, id
    tail: DataFrame | None

    def _in_head(self, way: str, out_type: str, default: int | None = None):
        name, head = self.name, self.head

        @F.arrow_udf(f"array<{out_type}>")
        def look_up(rows: pa.Array) -> pa.Array:
            found = Head.of(name, head).look_up(way, flat(rows), default)
            return regroup(found, ends(rows), rows.is_null() if rows.null_count else None)

        return look_up

    def _marked(self, way: str, columns: int):
        """The key of what a row asks for, null if it lacks nothing, and places in the head for each of its columns."""
        name, head = self.name, self.head
        fields = [f"places{n}" for n in range(columns)]

        @F.arrow_udf(f"struct<key: binary, {', '.join(f'{f}: binary' for f in fields)}>")
        def mark(*rows: pa.Array) -> pa.Array:
            places, valid, rest = _lacking(Head.of(name, head), way, rows)
            sizes = np.cumsum([0, *(len(flat(r)) for r in rows)])
            out = [
                packed(pa.array(places[a:b], mask=~valid[a:b]), ends(r), r.is_null() if r.null_count else None)
                for r, a, b in zip(rows, sizes, sizes[1:])
            ]
            return pa.StructArray.from_arrays([_keys(rest), *out], ["key", *fields])

        return mark

    def _asked(self, way: str, source_type: str):
        """What a row asks for, and its key."""
        name, head = self.name, self.head

        @F.arrow_udf(f"struct<key: binary, rest: array<{source_type}>>")
        def ask(*rows: pa.Array) -> pa.Array:
            rest = _lacking(Head.of(name, head), way, rows)[2]
            return pa.StructArray.from_arrays([_keys(rest), rest], ["key", "rest"])

        return ask

    def _filled(self, way: str, out_type: str, default: int | None):
        """Targets at places, the head's own or those that the tail has for the row; else ``default``."""
        name, head = self.name, self.head

        @F.arrow_udf(f"array<{out_type}>")
        def fill(rows: pa.Array, found: pa.Array) -> pa.Array:
            targets, (answers, answered) = Head.of(name, head).targets(way), unpacked(found)
            at, stops = unpacked(rows)
            valid = at.is_valid().to_numpy(zero_copy_only=False)
            places = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            lacking = np.flatnonzero(places < 0)
            row, number = np.repeat(np.arange(len(rows)), np.diff(stops, prepend=0))[lacking], -1 - places[lacking]
            sizes = np.diff(answered, prepend=0)
            places[lacking] = np.where(number < sizes[row], len(targets) + answered[row] - sizes[row] + number, -1)
            every = pa.concat_arrays([targets, answers.cast(targets.type)])
            out = every.take(pa.array(places, mask=~valid | (places < 0)))
            out = out if default is None else pc.fill_null(out, pa.scalar(default, out.type))
            return regroup(out, stops, rows.is_null() if rows.null_count else None)

        return fill

    def _whole(self) -> None:
        if self.tail is not None:
            raise ValueError("the vocabulary has entries behind its head; encode and decode take whole tables")

    def encode(self, tokens: Column, unk: int = UNK) -> Column:
        self._whole()
        return self._in_head("encode", "int", unk)(tokens)

    def decode(self, ids: Column, specials: Sequence[int] = tuple(range(len(SPECIALS)))) -> Column:
        """Tokens of the ids, without the specials and without ids the vocabulary lacks."""
        self._whole()
        return F.array_compact(self._in_head("decode", "string")(_real(ids, specials)))


def _lacking(head: Head, way: str, rows: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Places of all elements in the head, which elements are not null, and each row's different sources that the head lacks.

    A lacking source has the place -1 - k if it is the row's k-th. Their order hangs on the row alone.
    """
    coded = pa.concat_arrays([flat(r) for r in rows]).dictionary_encode()
    row = np.concatenate([_rows_of(r) for r in rows])
    valid = coded.indices.is_valid().to_numpy(zero_copy_only=False)
    asked = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.full(len(asked), -1, np.int32)
    if len(coded.dictionary):
        places[valid] = head.find(way, coded.dictionary)[asked[valid]]
    lacking = np.flatnonzero(valid & (places < 0))
    kinds = max(1, len(coded.dictionary))
    pairs, first, which = np.unique(row[lacking] * kinds + asked[lacking], return_index=True, return_inverse=True)
    order = np.lexsort((first, pairs // kinds))
    counts = np.bincount(pairs // kinds, minlength=len(rows[0]))
    rest_ends = np.cumsum(counts, dtype=np.int64)
    number = np.empty(len(pairs), np.int64)
    number[order] = np.arange(len(pairs)) - np.repeat(rest_ends - counts, counts)
    places[lacking] = -1 - number[which]
    return places, valid, regroup(coded.dictionary.take(pa.array(pairs[order] % kinds)), rest_ends)


def _keys(rest: pa.ListArray) -> pa.Array:
    """SHA-256 of each row's elements, null if it has none: lengths and bytes of strings, or the numbers."""
    sources, stops = flat(rest), ends(rest)
    if pa.types.is_integer(sources.type):
        sizes, data, starts = None, sources.to_numpy(), np.arange(len(sources) + 1)
    else:
        sources = sources.cast(pa.large_string())
        _, offsets, raw = sources.buffers()
        data = np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)
        starts = np.frombuffer(offsets, np.int64)[sources.offset :] if len(sources) else np.zeros(1, np.int64)
        sizes = np.diff(starts)
    keys, a = [], 0
    for b in stops.tolist():
        made = hashlib.sha256(sizes[a:b]) if sizes is not None else hashlib.sha256()
        made.update(data[starts[a] : starts[b]])
        keys.append(made.digest() if b > a else None)
        a = b
    return pa.array(keys, pa.binary())


def _rows_of(lists: pa.Array) -> np.ndarray:
    """The row of every element."""
    return np.repeat(np.arange(len(lists)), np.diff(ends(lists), prepend=0))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows of (key, rest) that have ``size`` elements at most, or one row."""
    held, room = [], size
    for batch in batches:
        stops, a = ends(batch.column("rest")), 0
        while a < len(stops):
            before = stops[a - 1] if a else 0
            b = int(np.searchsorted(stops, before + room, side="right"))
            if b == a and not held:
                b = a + 1
            if b > a:
                held.append(batch.slice(a, b - a))
                room -= int(stops[b - 1] - before)
            if b < len(stops):
                yield held
                held, room = [], size
            a = b
    if held:
        yield held


_HEADER = "struct<keys: array<binary>, sizes: array<int>, picks: binary>"


def _indexed(asked: DataFrame, source_type: str) -> DataFrame:
    """(chunk, number, source) for each different source of a chunk, and a row with the number -1 and a header:
    the chunk's different keys, and which sources each asks for.

    Rows come in the order of their keys, so a task that runs again makes the same chunks. Frequent
    sources have small numbers. A header's source only spreads the headers.
    """
    schema = f"chunk bigint, number int, source {source_type}, header {_HEADER}"

    def part(chunk: int, numbers: np.ndarray, sources: pa.Array, headers: pa.Array) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(numbers), chunk)), pa.array(numbers, pa.int32()), sources, headers]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "number", "source", "header"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for chunk, held in enumerate(_chunks(batches, CHUNK), first):
            keys = pa.concat_arrays([b.column("key") for b in held])
            new = keys.is_valid().to_numpy(zero_copy_only=False)
            new[1:] &= pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False)
            if not new.any():
                continue
            keys, kept = keys.filter(pa.array(new)), np.split(new, np.cumsum([len(b) for b in held])[:-1])
            rest = pa.chunked_array([b.column("rest").filter(pa.array(k)) for b, k in zip(held, kept)])
            held.clear()
            sizes = pc.list_value_length(rest).to_numpy().astype(np.int32)
            coded = pa.chunked_array([flat(r) for r in rest.chunks]).dictionary_encode().unify_dictionaries()
            del rest
            sources = coded.chunk(0).dictionary
            asked = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
            order = np.argsort(-np.bincount(asked), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            picks = pa.compress(packed(pa.array(rank[asked]), [len(asked)])[0].as_buffer(), "zstd", asbytes=True)
            head = [regroup(keys, [len(keys)]), regroup(pa.array(sizes), [len(sizes)]), pa.array([picks], pa.binary())]
            header = pa.StructArray.from_arrays(head, ["keys", "sizes", "picks"])
            yield part(chunk, np.array([-1]), pa.array([chunk]).cast(sources.type), header)
            for a in range(0, len(order), 1 << 16):
                some = sources.take(pa.array(order[a : a + (1 << 16)]))
                yield part(chunk, np.arange(a, a + len(some)), some, pa.nulls(len(some), header.type))

    return asked.sortWithinPartitions("key").mapInArrow(index, schema)


def _answered(joined: DataFrame, target_type: str) -> DataFrame:
    """(key, found): the targets of what a row asked for, in its order, null where the tail has none."""
    pack, lists = (packed, "binary") if target_type == "int" else (regroup, f"array<{target_type}>")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gathered() -> pa.RecordBatch:
            chunks, numbers, targets = (pa.concat_arrays([b.column(c) for b in held]) for c in ("chunk", "number", "target"))
            order = np.lexsort((numbers, chunks))
            names, counts = np.unique(chunks, return_counts=True)
            stops = np.cumsum(counts)
            # Each number by its distance from the one before.
            steps = np.diff(numbers.to_numpy()[order], prepend=0)
            steps[stops - counts] = numbers.to_numpy()[order[stops - counts]]
            columns = [pa.array(names), packed(pa.array(steps), stops), pack(targets.take(pa.array(order)), stops)]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(names), header)], fields)

        fields, held, rows, header = ["chunk", "steps", "targets", "header"], [], 0, None
        for batch in batches:
            header = batch.schema.field("header").type
            heads = batch.filter(pc.less(batch.column("number"), 0))
            if len(heads):
                none, nothing = batch.slice(0, 0), np.zeros(len(heads), np.int64)
                empty = [packed(none.column("number"), nothing), pack(none.column("target"), nothing)]
                yield pa.RecordBatch.from_arrays([heads.column("chunk"), *empty, heads.column("header")], fields)
            held.append(batch.filter(pc.and_(pc.greater_equal(batch.column("number"), 0), batch.column("target").is_valid())))
            rows += len(held[-1])
            if rows >= GATHERED:
                yield gathered()
                held, rows = [], 0
        if rows:
            yield gathered()

    def assemble(rows: pa.Table) -> pa.Table:
        header = next(h for h in rows.column("header").combine_chunks() if h.is_valid)
        stops = np.cumsum(header["sizes"].values, dtype=np.int64)
        size = int(stops[-1])
        picks = unpacked(pa.array([pa.decompress(header["picks"].as_py(), 5 * size, "zstd", asbytes=True)]))[0].to_numpy()
        at, seen, targets = np.full(int(picks.max()) + 1, -1, np.int32), 0, []
        for steps, some in zip(rows.column("steps").chunks, rows.column("targets").chunks):
            steps, list_ends = unpacked(steps)
            numbers, sizes = np.cumsum(np.concatenate(([0], steps)), dtype=np.int64), np.diff(list_ends, prepend=0)
            at[numbers[1:] - np.repeat(numbers[list_ends - sizes], sizes)] = np.arange(seen, seen + len(steps))
            targets.append(unpacked(some)[0])
            seen += len(steps)
        at = at[picks]
        found = pa.concat_arrays(targets).take(pa.array(at, mask=at < 0))
        return pa.table({"key": header["keys"].values, "found": pack(found, stops)})

    packets = joined.mapInArrow(gather, f"chunk bigint, steps binary, targets {lists}, header {_HEADER}")
    answers = packets.groupBy("chunk").applyInArrow(assemble, f"key binary, found {lists}")
    return answers.groupBy("key").agg(F.first("found").alias("found"))


def _real(ids: Column, specials: Sequence[int]) -> Column:
    return F.filter(ids, lambda i: ~i.isin(list(specials))) if specials else ids


def load_codec(vocab: DataFrame, head_rows: int = HEAD_ROWS) -> Codec:
    """Write the vocabulary once to the shared folder, broadcast its head and keep the rest as a table."""
    spark, name = vocab.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark)}/vocabulary-{name}"
    vocab.select("token", F.col("id").cast("int").alias("id")).write.parquet(path)
    stored = spark.read.schema("token string, id int").parquet(path)
    in_head = (F.col("id") < head_rows) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    table = stored.where(in_head).toArrow().combine_chunks()
    columns = {c: table.column(c).combine_chunks() for c in table.column_names}
    head = spark.sparkContext.broadcast(pa.RecordBatch.from_pydict(columns))
    tail = stored.where(~in_head) if stored.count() > table.num_rows else None
    return Codec(name, head, tail)


def _two_tiers(df: DataFrame, columns: dict[str, str], codec: Codec, way: str, out_type: str, default: int | None) -> DataFrame:
    """Replace array elements by the head's entries, and what it lacks by the tail's, or else by ``default``.

    A row travels with places in the head, never with its texts.
    """
    if codec.tail is None:
        return df.withColumns({out: codec._in_head(way, out_type, default)(F.col(c)) for c, out in columns.items()})
    mark = uuid.uuid4().hex[:8]
    key, found, marked = f"key_{mark}", f"found_{mark}", f"marked_{mark}"
    places = [f"places{n}_{mark}" for n in range(len(columns))]
    source, target, source_type = ("token", "id", "string") if way == "encode" else ("id", "token", "bigint")
    given = [F.col(c).cast(f"array<{source_type}>") for c in columns]
    asked = df.select(codec._asked(way, source_type)(*given).alias(marked)).select(f"{marked}.*")
    tail = codec.tail.select(F.col(source).cast(source_type).alias("source"), F.col(target).alias("target"))
    joined = _indexed(asked, source_type).join(tail, "source", "left").select("chunk", "number", "target", "header")
    answers = _answered(joined, out_type).toDF(key, found)
    both = df.withColumn(marked, codec._marked(way, len(columns))(*given))
    both = both.withColumns({p: F.col(marked)[f"places{n}"] for n, p in enumerate(places)})
    # Rows that lack nothing have keys of their own kind, spread over all tasks.
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    alone = F.xxhash64(*numbers, places[0]).cast("string").cast("binary")
    out = both.withColumn(key, F.coalesce(F.col(marked)["key"], alone)).drop(marked).join(answers, key, "left")
    fill = codec._filled(way, out_type, default)
    return out.withColumns({o: fill(F.col(p), F.col(found)) for p, o in zip(places, columns.values())}).drop(key, found, *places)


def encode(
    df: DataFrame,
    vocab: DataFrame | Codec,
    columns: dict[str, str],
    unk: int = UNK,
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """Add id arrays: ``columns`` maps token-array columns to output columns.

    Unknown tokens get ``unk``; a null array stays null. A loaded codec in place of the table spares
    storing the vocabulary again.
    """
    codec = vocab if isinstance(vocab, Codec) else load_codec(vocab, head_rows)
    return _two_tiers(df, columns, codec, "encode", "int", unk)


def decode(
    df: DataFrame,
    vocab: DataFrame | Codec,
    columns: dict[str, str],
    specials: Sequence[int] = tuple(range(len(SPECIALS))),
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """Add decoded text: drop specials, join by spaces, then tidy the spacing."""
    codec = vocab if isinstance(vocab, Codec) else load_codec(vocab, head_rows)
    real = {c: f"real{n}_{uuid.uuid4().hex[:8]}" for n, c in enumerate(columns)}
    out = df.withColumns({r: _real(F.col(c), specials) for c, r in real.items()})
    out = _two_tiers(out, {r: columns[c] for c, r in real.items()}, codec, "decode", "string", None).drop(*real.values())
    return out.withColumns({name: clean_decoded(F.array_join(F.array_compact(F.col(name)), " ")) for name in columns.values()})


def pad_to_longest(
    df: DataFrame, pad: int, batch: str = "batch_id", ids: str = "input_ids", multiple: int = 1, side: str = "right"
) -> DataFrame:
    """Pad to the longest row of the batch, rounded up; a batch is bounded by its size."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    length = (F.ceil(longest / multiple) * multiple).cast("int")
    return (
        df.withColumn("padded_length", length)
        .withColumn("attention_mask", arrays.attention_mask(F.size(ids), F.col("padded_length"), side))
        .withColumn(ids, arrays.pad_to(F.col(ids), F.col("padded_length"), pad, side))
    )
