"""Written tables that cut lineage, positions in a sorted key, and Arrow batches by size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How many answers a worker remembers, and the longest question it remembers.
REMEMBERED = 120_000
LONG = 64
#: Rows of a batch are handled together up to this many bytes of text, so numpy's work arrays stay small.
PIECE_BYTES = 2 << 20
PIECE_ROWS = 1024


def new_folder(spark: SparkSession) -> str:
    """A new folder for this run below ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets one of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="sheafwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def keep(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table and read it back: later steps start from its files, not from its lineage."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, key: str, folder: str, name: str) -> DataFrame:
    """Add ``position``, 0, 1, ... in ascending order of the distinct, non-null column ``key``.

    The rows are cut into ranges of the key; a range is numbered by one task, and the ranges'
    row counts (one row each) give the offsets. No task sees more than its own range.
    """
    ranged = keep(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), folder, name)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    numbered = ranged.withColumn("_inside", inside).join(offsets, "_range")
    return numbered.withColumn("position", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most ``limit`` bytes in ``column`` and ``PIECE_ROWS`` rows, one at least."""
    for batch in batches:
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + PIECE_ROWS, int(np.searchsorted(ends, done + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; a null has none."""
    offsets = buffer_of(column)[1]
    return np.diff(offsets)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values in a row, and the offsets at which each starts (and the last ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finalizer of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def append(
    df: DataFrame,
    column: str,
    fields: str,
    prepare: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    limit: int = PIECE_BYTES,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Add columns that Python computes from ``column``, slice by slice of at most ``limit`` bytes.

    ``prepare`` runs once in each task and gives the function from a slice of the column to the new
    columns, in the order of the DDL string ``fields``. Columns of the same names are replaced. ``done``
    runs when a task ends; what the task has remembered is let go, as its worker may serve other stages.
    """
    new = T.StructType.fromDDL(fields)
    rest = [c for c in df.columns if c not in new.names]
    df = df.select(*(F.col(f"`{c}`") for c in rest))

    def run(batches):
        work = prepare()
        try:
            for piece in pieces(batches, column, limit):
                arrays = work(piece.column(column))
                yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], names=rest + new.names)
        finally:
            del work
            _POWERS.clear()
            if done is not None:
                done()

    return df.mapInArrow(run, T.StructType(df.schema.fields + new.fields))


class Memory(dict):
    """What a function gave for the keys asked so far; a full memory starts anew."""

    def __init__(self, find: Callable):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        found = self.find(key)
        if len(key) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = found
        return found


def stretches(text: str, limit: int = 1 << 20) -> Iterator[list[str]]:
    """The text between blanks and line ends, some ``limit`` characters at a time."""
    text, start = text.replace("\n", " "), 0
    while len(text) - start > limit:
        cut = text.rfind(" ", start, start + limit)
        cut = cut if cut > start else text.find(" ", start + limit)
        if cut < 0:
            break
        yield text[start:cut].split(" ")
        start = cut + 1
    yield text[start:].split(" ")


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2 ** 64 for i < n at least."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        found = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[size] = found[0], found[1]
    return _POWERS[size]


def running_sums(raw: np.ndarray) -> np.ndarray:
    """Sums from which :func:`hash_between` takes the hash of any stretch of the bytes."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], out=sums[1:])
    return sums


def hash_between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from ``start`` up to ``end``; equal bytes have equal hashes."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between ASCII white space, and the number of words before each text."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    solid = ~space
    opens = solid & (first[:-1] | np.concatenate(([True], space[:-1])))
    closes = solid & (first[1:] | np.concatenate((space[1:], [True])))
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return hash_between(running_sums(raw), start, end), np.searchsorted(start, at)


def sampled(labels: DataFrame, label: str, id_col: str, rows: int, salt: int) -> DataFrame:
    """About ``rows`` of the rows of each class, 0 and 1, chosen by a hash of the id; all if there are fewer.

    The result has at most a bounded number of rows of each class, however many there are.
    """
    counts = {r["c"]: r["n"] for r in labels.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("n")).where("c in (0, 1)").collect()}
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col(label) == c, F.lit(rows / n)).otherwise(share)
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    return labels.where(at < share)
