"""Merkle manifest of a dataset with an inclusion proof for every row, by pointer jumping.

A row's leaf is the digest of its fields. The leaves of a source, by id, form a tree: every ``WIDTH``
neighbours become the digest of their digests until one is left, the source's subroot; the subroots,
by source, form the tree above in the same way. All nodes of a level are made at once, by grouping.

A proof lists the siblings on the way from a leaf to the root. Every inner node starts with the segment
of its own siblings and a pointer to its parent. A join of the table with itself appends the segment
of the node pointed to and takes over its pointer, so the distance to the ancestor doubles each time and
a tree of height h needs log2(h) joins. The leaves of one run share the way above their parent, so
they join the finished segments last, a run of siblings in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import keep, new_folder
from sheafwork.llm.ordering import running

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the subroots; sources have "-" (null) or "=" and their name.
TOP = ""
_KEY = ("tree", "level", "at")


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def parent(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def fold(start: Column, segments: Column) -> Column:
    """The digest at the end of the way that begins with ``start`` and has these siblings on each level."""
    return F.aggregate(segments, start, lambda done, s: F.sha2(F.concat(s["left"], done, s["right"]), 256))


def proof_digest(segments: Column) -> Column:
    """SHA-256 of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _sides(digests: Column, place: Column) -> Column:
    """The siblings on both sides of a place, as one string each."""
    count = F.size(digests)
    return F.struct(
        F.array_join(F.slice(digests, F.lit(1), place), "").alias("left"),
        F.array_join(F.slice(digests, place + 2, F.greatest(count - place - 1, F.lit(0))), "").alias("right"),
    )


def _levels(nodes: DataFrame, most: int, folder: str, name: str, base: int) -> list[DataFrame]:
    """Runs of siblings from level ``base`` up; ``nodes`` has tree, level, at, total (of its level), digest, own_tree, own_level.

    ``most`` is the largest total. Each row of the result is a run: its tree, level and number, its
    members in order, and the digest that becomes a node of the next level.
    """
    runs, level = [], base
    while most > 1:
        made = (
            nodes.where("total > 1")
            .groupBy("tree", F.expr(f"at div {WIDTH}").alias("run"))
            .agg(F.sort_array(F.collect_list(F.struct("at", "digest", "own_tree", "own_level"))).alias("members"), F.min("total").alias("total"))
        )
        made = made.select("tree", F.lit(level).alias("level"), "run", "members", F.expr(f"(total + {WIDTH - 1}) div {WIDTH}").alias("above"), parent(F.col("members.digest")).alias("digest"))
        made = keep(made, folder, f"{name}{level}")
        runs.append(made)
        level, most = level + 1, -(-most // WIDTH)
        nodes = made.select("tree", F.lit(level).alias("level"), F.col("run").alias("at"), F.col("above").alias("total"), "digest", F.col("tree").alias("own_tree"), F.lit(level).alias("own_level"))
    return runs


def _members(runs: DataFrame) -> DataFrame:
    """Nodes with the segment of their siblings, a pointer to the parent, and the subroot where it is known."""
    each = runs.select("*", F.posexplode("members").alias("place", "own"))
    subroot = F.when(F.col("tree") == TOP, F.when(F.col("level") == 0, F.col("own.digest"))).otherwise(F.when(F.col("above") == 1, F.col("digest")))
    # A subroot is known by its place in its source's tree, not by that among the subroots.
    is_subroot = (F.col("tree") == TOP) & (F.col("level") == 0)
    return each.select(
        F.col("own.own_tree").alias("tree"),
        F.col("own.own_level").cast("int").alias("level"),
        F.when(is_subroot, F.lit(0)).otherwise(F.col("own.at")).cast("long").alias("at"),
        F.array(_sides(F.col("members.digest"), F.col("place"))).alias("segments"),
        F.struct(F.col("tree").alias("tree"), (F.col("level") + 1).cast("int").alias("level"), F.col("run").cast("long").alias("at")).alias("to"),
        subroot.alias("subroot"),
    )


def _jump(nodes: DataFrame, distance: int, salts: int) -> DataFrame:
    """Every node ``distance`` below the one it points to, from then on twice as far.

    Up to ``WIDTH ** distance`` nodes point to one, so copies of the targets, far fewer than the
    nodes, spread them over ``salts`` keys. A pointer to the root finds no row and is done.
    """
    salts = max(1, min(WIDTH ** (distance - 1), salts))
    # Only nodes that others are this far below are targets; these alone are copied.
    met = nodes.select(F.col("to").alias("target")).where("target IS NOT NULL").distinct()
    targets = nodes.select(F.struct(*_KEY).alias("target"), F.col("segments").alias("more"), F.col("to").alias("further"), F.col("subroot").alias("known"))
    targets = targets.join(met, "target", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = nodes.withColumn("own_salt", F.pmod("at", F.lit(salts)).cast("int"))
    joined = left.join(targets, (F.col("to") == F.col("target")) & (F.col("own_salt") == F.col("salt")), "left")
    return joined.select(
        *_KEY,
        F.concat("segments", F.coalesce("more", F.array().cast(targets.schema["more"].dataType))).alias("segments"),
        F.col("further").alias("to"),
        F.coalesce("subroot", "known").alias("subroot"),
    )


def proofs(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """One row for each input row: its id, ``leaf``, ``subroot``, ``root``, ``segments`` and ``seen``.

    ``segments`` is the proof, ``array<struct<left, right>>`` from the leaf's level to the root: the digests of
    the siblings on both sides. ``seen`` is the leaf as a reader would find it: of the rows where
    ``tampered`` holds, with A-Z in the text lower-cased, of all others the same as ``leaf``. Nulls
    in any field are allowed and differ from empty values; a null source is a source of its own and comes
    first, as a null id does within its source. Texts of any length count whole. Rows of one id are
    ordered by their leaves; equal rows have equal leaves, and each has its own proof. An empty table
    gives no rows. Columns other than ``fields`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    folder = new_folder(spark)
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.coalesce(tampered if tampered is not None else F.lit(False), F.lit(False))
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    leaves = docs.select(
        tree.alias("tree"),
        F.col(id_col).alias("id"),
        leaf([F.col(f) for f in fields]).alias("leaf"),
        F.when(changed, leaf([lowered if f == text_col else F.col(f) for f in fields])).alias("other"),
    )
    # Equal rows are one with a count until they are numbered, so that no range holds all copies of one.
    leaves = keep(leaves.groupBy("tree", "id", "leaf", "other").agg(F.count("*").alias("copies")), folder, "leaves")
    placed = running(leaves, "tree", ["id", "leaf"], F.col("copies"), folder, "placed")
    placed = placed.select("*", F.explode(F.sequence(F.col("inside"), F.col("inside") + F.col("copies") - 1)).alias("at"))
    member = F.struct("at", F.col("leaf").alias("digest"), "id", F.coalesce("other", "leaf").alias("seen"))
    runs = placed.groupBy("tree", F.expr(f"at div {WIDTH}").alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members"), F.min("total").alias("total"))
    # A lone leaf is its source's subroot as it is; it counts as the only node of level 1.
    digest = F.when(F.col("total") > 1, parent(F.col("members.digest"))).otherwise(F.col("members")[0]["digest"])
    runs = keep(runs.withColumn("digest", digest), folder, "runs")
    lowest = runs.select("tree", F.lit(1).alias("level"), F.col("run").alias("at"), F.expr(f"(total + {WIDTH - 1}) div {WIDTH}").alias("total"), "digest", F.col("tree").alias("own_tree"), F.lit(1).alias("own_level"))
    most = runs.agg(F.max("total")).first()[0]
    if most is None:
        most = 0
    levels = _levels(lowest, -(-most // WIDTH), folder, "level", 1)
    finished = lowest.where("total = 1").select("tree", "level", "digest")
    for made in levels:
        finished = finished.unionByName(made.where("above = 1").select("tree", (F.col("level") + 1).alias("level"), "digest"))
    finished = keep(finished.select(F.lit(TOP).alias("top"), F.col("tree").alias("own_tree"), F.col("level").alias("own_level"), "digest"), folder, "subroots")
    subroots = running(finished, "top", ["own_tree"], F.lit(1), folder, "sources")
    subroots = keep(subroots.select(F.col("top").alias("tree"), F.lit(0).alias("level"), F.col("before").alias("at"), "total", "digest", "own_tree", "own_level"), folder, "above")
    sources = subroots.count()
    upper = _levels(subroots, sources, folder, "top", 0)
    root = (upper[-1] if upper else finished).select("digest").first()
    nodes = None
    for made in [*levels, *upper]:
        members = _members(made)
        nodes = members if nodes is None else nodes.unionByName(members)
    height, distance = len(levels) + len(upper), 1
    if nodes is not None:
        nodes = keep(nodes, folder, "jump0")
        while distance < height:
            nodes = keep(_jump(nodes, distance, int(spark.conf.get("spark.sql.shuffle.partitions"))), folder, f"jump{distance}")
            distance *= 2
        ways = nodes.where("level = 1").select(F.col("tree").alias("way_tree"), F.col("at").alias("way_run"), "segments", F.col("subroot").alias("way_subroot"))
        found = runs.join(ways, (F.col("tree") == F.col("way_tree")) & (F.col("run") == F.col("way_run")), "left")
    else:
        found = runs.withColumn("segments", F.lit(None).cast("array<struct<left string, right string>>")).withColumn("way_subroot", F.lit(None).cast("string"))
    each = found.select("*", F.posexplode("members").alias("place", "own"))
    empty = F.array().cast("array<struct<left: string, right: string>>")
    own = F.when(F.col("total") > 1, F.array(_sides(F.col("members.digest"), F.col("place")))).otherwise(empty)
    return each.select(
        F.col("own.id").alias(id_col),
        F.col("own.digest").alias("leaf"),
        # A node without a way up is the root, or the subroot that the way starts from.
        F.coalesce("way_subroot", "digest").alias("subroot"),
        F.lit(root["digest"] if root else None).cast("string").alias("root"),
        F.concat(own, F.coalesce("segments", empty)).alias("segments"),
        F.col("own.seen").alias("seen"),
    )


def verified(proven: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of :func:`proofs` with the digest of the proof, and whether ``seen`` folds to the root with it."""
    done = proven.withColumn("folded_root", fold(F.col("seen"), F.col("segments")))
    return done.select(id_col, "leaf", "subroot", "root", proof_digest(F.col("segments")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
