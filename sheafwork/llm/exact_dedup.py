"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text is cut into fixed-size blocks of bytes. The distinct blocks are sorted and
numbered; then neighbouring names are paired, the distinct pairs are numbered, and so on until one
name is left for each document. Names come from sorting whole blocks and whole pairs, so equal
names mean equal texts: a hash only says where to look a block up, and blocks that share a hash
are told apart by their bytes.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import keep, new_folder, text_or_empty

#: Fixed value: what counts as white space when texts are compared.
SPACES = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 8192


def normalise(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Sort within each shuffle partition and number; the numbers of two partitions never meet."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(docs: DataFrame, prints: DataFrame, folder: str, blocks: Column, hashed: Callable[[Column], Column]) -> DataFrame:
    """``row_id, pos, n, name`` for every block of every row."""
    single = docs.select(F.explode(blocks).alias("block"))
    distinct = single.select(hashed(F.col("block")).alias("h"), "block").groupBy("h", "block").agg(F.lit(1).alias("_"))
    # The block itself stays behind: a hash with one block is its name's address.
    names = keep(
        _numbered(distinct.select("h", "block"), "h", "block").groupBy("h").agg(F.min("name").alias("name"), F.count("*").alias("blocks")),
        folder,
        "block-names",
    )
    places = prints.select("row_id", "n", F.posexplode("hashes").alias("pos", "h"))
    named = places.join(names, "h")
    clear = named.where("blocks = 1").select("row_id", "pos", "n", "name")
    shared = keep(names.where("blocks > 1").select("h"), folder, "shared-hashes")
    if shared.isEmpty():
        return clear
    # Blocks under one hash: number the blocks themselves, below zero, away from the other names.
    # Id and digest only lead a block back to its own row.
    unclear = docs.select("_id", "_sha", F.posexplode(blocks).alias("pos", "block")).withColumn("h", hashed(F.col("block")))
    unclear = unclear.join(shared, "h", "left_semi")
    told = keep(_numbered(unclear.select("h", "block").distinct(), "h", "block"), folder, "told-apart")
    apart = unclear.join(told, ["h", "block"]).select("_id", "_sha", "pos", (-1 - F.col("name")).alias("name")).distinct().alias("a")
    own = F.col("p._id").eqNullSafe(F.col("a._id")) & (F.col("p.text_sha256") == F.col("a._sha"))
    return clear.unionByName(prints.alias("p").join(apart, own).select("row_id", "pos", "n", "name"))


def identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    hashed: Callable[[Column], Column] = F.xxhash64,
    folder: str | None = None,
) -> DataFrame:
    """One row per input row: ``row_id``, the id column, ``text_sha256``, and its identity ``n, name``.

    ``n`` is the number of blocks. Two rows have equal ``(n, name)`` exactly if their normalised
    texts are equal. A null text is empty, an empty text is one empty block. ``row_id`` numbers
    the rows as they are read, so repeated ids and repeated rows stay apart.
    """
    folder = folder or new_folder(docs.sparkSession)
    raw = F.col("_bytes")
    n = F.greatest(F.lit(1), F.ceil(F.length(raw) / F.lit(block_bytes)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))
    bytes_of = docs.select(F.col(id_col).alias("_id"), normalise(F.col(text_col)).cast("binary").alias("_bytes"))
    sha = F.sha2(raw, 256)
    prints = keep(
        bytes_of.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col("_id"),
            n.alias("n"),
            sha.alias("text_sha256"),
            F.transform(blocks, lambda b: hashed(b)).alias("hashes"),
        ),
        folder,
        "prints",
    )
    level = keep(_name_blocks(bytes_of.withColumn("_sha", sha), prints, folder, blocks, hashed), folder, "level-0")
    done, step = level.where("n = 1").select("row_id", "n", "name"), 0
    widest = prints.agg(F.max("n")).first()[0] or 1
    while (1 << step) < widest:
        step += 1
        # Rows whose names of the level before were more than one: 2^(step-1) < n.
        active = level.where(F.col("n") > (1 << (step - 1)))
        half = F.shiftright("pos", 1).cast("int")
        pairs = active.groupBy("row_id", "n", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("second"),
            F.count("*").alias("width"),
        )
        pairs = keep(pairs.withColumn("second", F.coalesce("second", F.lit(0))), folder, f"pairs-{step}")
        names = keep(_numbered(pairs.select("first", "second", "width").distinct(), "first", "second", "width"), folder, f"names-{step}")
        level = keep(pairs.join(names, ["first", "second", "width"]).select("row_id", "pos", "n", "name"), folder, f"level-{step}")
        done = done.unionByName(level.where((F.col("n") > (1 << (step - 1))) & (F.col("n") <= (1 << step))).select("row_id", "n", "name"))
    return prints.select("row_id", F.col("_id").alias(id_col), "text_sha256").join(done, "row_id")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the smallest id stays; a null id comes after all others. Of
    several rows with that id the first as read stays, so one row of each group is kept. An
    empty table gives no rows. Other columns of the input are not touched, whatever their names.
    """
    folder = options.pop("folder", None) or new_folder(docs.sparkSession)
    rows = keep(identities(docs, id_col, text_col, folder=folder, **options), folder, "identities")
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col("row_id").alias("row"))
    groups = keep(rows.groupBy("n", "name").agg(F.min(order).alias("stays"), F.count("*").alias("group_size")), folder, "groups")
    joined = rows.join(groups, ["n", "name"])
    return joined.select(
        F.col(id_col),
        F.col("stays.id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("stays.row")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the rows that :func:`duplicates` drops; columns as they were.

    Where an id repeats among rows with one text, one of these rows stays.
    """
    folder = new_folder(docs.sparkSession)
    own_id, own_sha, sha = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "sha", "own"))  # names that the input lacks
    rows = duplicates(docs, id_col, text_col, folder=folder)
    stay = keep(rows.where("kept").select(F.col(id_col).alias(own_id), F.col("text_sha256").alias(own_sha)), folder, "stay")
    twins = rows.where(~F.col("kept") & F.col(id_col).eqNullSafe(F.col("keep_id")))
    twins = keep(twins.select(F.col(id_col).alias(own_id), F.col("text_sha256").alias(own_sha)).distinct(), folder, "twins")
    keyed = docs.withColumn(sha, F.sha2(normalise(F.col(text_col)).cast("binary"), 256))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(own_sha))
    left = keyed.join(stay, same, "left_semi")
    if not twins.isEmpty():
        once, again = left.join(twins, same, "left_anti"), left.join(twins, same, "left_semi")
        left = once.unionByName(again.dropDuplicates([id_col, sha]))
    return left.drop(sha)
