"""Feature tables on disk: cache keys, write once, read back."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cache_key(split: Column, tokenizer: Column, max_len: Column, task: Column) -> Column:
    """``cached_{split}_{Name}_{len}_{task}``.

    Capitals in the tokenizer name are removed before title-casing, with everything else
    that is not a lower-case letter.
    """
    name = F.replace(F.initcap(F.regexp_replace(tokenizer, "[^a-z]+", " ")), F.lit(" "), F.lit(""))
    return F.concat(F.lit("cached_"), F.concat_ws("_", split, name, max_len.cast("string"), task))


def write_features(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Typed Parquet output, overwriting what is there.

    A folder name cannot tell an empty text from a missing one, so an empty text in a folder
    column raises an error. Folders by column are written after a rebalance on those columns: few files per folder,
    and a folder that holds much of the data is still split over several tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
        texts = [c for c in partition_by if df.schema[c].dataType.typeName() == "string"]
        refused = F.raise_error(F.lit("an empty text can't name a folder")).cast("string")
        df = df.withColumns({c: F.when(F.col(c) == "", refused).otherwise(F.col(c)) for c in texts})
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


MANIFEST = "fingerprint string, folder string, columns string, written_at timestamp"


def _stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The table at ``path``, without rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def fingerprint(spark: SparkSession, sources: Sequence[str], arguments: Mapping | None = None, columns: str = "") -> str:
    """Digest of the source files (path, bytes, time of change), the arguments and the columns.

    Spark lists the files and adds up a hash of each; their content is not read.
    """
    files = 0, 0, 0
    if sources:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted(set(sources)))
        one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
        files = tuple(found.agg(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.bit_xor(one)).first())
    said = json.dumps([[str(x) for x in files], dict(arguments or {}), columns], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()


def materialize_features(
    df: DataFrame | Callable[[], DataFrame],
    root: str,
    key: str,
    overwrite: bool = False,
    sources: Sequence[str] | None = None,
    arguments: Mapping | None = None,
    stale: str = "refuse",
    spark: SparkSession | None = None,
) -> DataFrame:
    """Write ``df`` under ``root/key`` unless a committed copy of the same work exists, and read it back.

    The same work has the same source files, unchanged since, and the same arguments; for a DataFrame also the same
    columns, and ``sources`` are by default the files that it reads. A function is called only if
    its table has to be written; it needs ``sources`` and ``spark``. A copy of other work raises an
    error, or is written anew with ``stale="rewrite"``.

    Each copy has a folder of its own. A row in the manifest, appended when the copy is complete, commits it, so what a
    lost driver or a second writer leaves half done is never read. The plan that
    comes back starts at the written files: a lost executor costs a re-read and not the encoding.
    """
    if stale not in ("refuse", "rewrite"):
        raise ValueError(f"stale must be 'refuse' or 'rewrite', not {stale!r}")
    later = not isinstance(df, DataFrame)
    if later and (sources is None or spark is None):
        raise ValueError("a function needs sources and spark")
    spark = spark if later else df.sparkSession
    columns = "" if later else df.schema.simpleString()
    path = f"{root.rstrip('/')}/{key}"
    work = fingerprint(spark, df.inputFiles() if sources is None else sources, arguments, columns)
    copies = _stored(spark, f"{path}/manifest", MANIFEST)
    same = copies.where(F.col("fingerprint") == work).orderBy(F.desc("written_at"), "folder").first()
    if same and not overwrite:
        return spark.read.schema(T.StructType.fromJson(json.loads(same["columns"]))).parquet(f"{path}/{same['folder']}")
    if not overwrite and stale == "refuse" and not copies.isEmpty():
        raise ValueError(f"the copy under {key!r} is of other sources, arguments or columns")
    table = df() if later else df
    folder = f"copy-{uuid.uuid4().hex}"
    write_features(table, f"{path}/{folder}")
    entry = spark.createDataFrame([(work, folder, table.schema.json())], "fingerprint string, folder string, columns string")
    entry.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return spark.read.schema(table.schema).parquet(f"{path}/{folder}")
