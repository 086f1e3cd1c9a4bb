"""Merkle trees over sections, paragraphs and leaves of a text, in DataFrame expressions only.

A section ends at an empty line, a paragraph at a line end, and a leaf after eight words or a
sentence's end. Leaves keep their white space, so they cover the whole text: the root, a SHA-256
of its sections' digests, differs as soon as any character does. Where two roots differ, only
the branches whose digests differ are followed to the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import keep, new_folder, positions, text_or_empty

WORDS_IN_LEAF = 8
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Up to seven words that end no sentence, one more word, and the white space around them.
LEAF = rf"{_SPACE}*(?:{_WORD}*[^\x20\x09-\x0D.!?]{_SPACE}+){{0,{WORDS_IN_LEAF - 1}}}{_WORD}+{_SPACE}*|{_SPACE}+"
_LAST_ID = 2**63 - 1


def _parent(kind: str, digests: Column) -> Column:
    """Digest of a node from its children's; the kind keeps levels apart."""
    return F.sha2(F.concat(F.lit(kind), F.array_join(digests, "")), 256)


def leaf_digests(text: Column) -> Column:
    """``array<array<array<string>>>``: the leaves' digests by section and paragraph.

    Null counts as empty; an empty text has one section with one paragraph without leaves.
    """
    return F.transform(
        F.split(text_or_empty(text), "\n\n", -1),
        lambda section: F.transform(
            F.split(section, "\n", -1),
            lambda paragraph: F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), 0), lambda leaf: F.sha2(leaf, 256)),
        ),
    )


def root(leaves: Column) -> Column:
    """The digest of the whole text from :func:`leaf_digests`."""
    return _parent("d", F.transform(leaves, _section))


def _section(paragraphs: Column) -> Column:
    return _parent("s", F.transform(paragraphs, _paragraph))


def _paragraph(leaves: Column) -> Column:
    return _parent("p", leaves)


def leaf_numbers(leaves: Column) -> Column:
    """The distinct leaves as integers of 60 bits: small enough to travel."""
    flat = F.array_distinct(F.flatten(F.flatten(leaves)))
    return F.transform(flat, lambda d: F.conv(F.substring(d, 1, 15), 16, 10).cast("long"))


def likeness(left: Column, left_root: Column, right: Column, right_root: Column) -> Column:
    """Shared share of leaves and root, 0 to 1: 1 only for equal roots. Two empty texts are equal."""
    same = (left_root == right_root).cast("int")
    return 2.0 * (F.size(F.array_intersect(left, right)) + same) / (F.size(left) + F.size(right) + 2)


def first_edit(before: Column, after: Column) -> Column:
    """``struct<section, paragraph, leaf>``, counted from 0, of the first branch in which two trees differ; null if none.

    Both sides come from :func:`leaf_digests`. On each level children are compared by place, and
    only the first differing one is followed. A branch that one side lacks gives -1 below it.
    """
    section = _first_difference(F.transform(before, _section), F.transform(after, _section))
    both = F.array(F.struct(section.alias("at"), before.alias("a"), after.alias("b")))

    def child(nodes: Column, at: Column) -> Column:
        return F.when(at >= 0, F.get(nodes, at))

    def paragraph(x: Column) -> Column:
        a, b = child(x["a"], x["at"]), child(x["b"], x["at"])
        at = F.when(a.isNull() | b.isNull(), -1).otherwise(_first_difference(F.transform(a, _paragraph), F.transform(b, _paragraph)))
        return F.struct(x["at"].alias("section"), at.alias("at"), a.alias("a"), b.alias("b"))

    def leaf(x: Column) -> Column:
        a, b = child(x["a"], x["at"]), child(x["b"], x["at"])
        at = F.when(a.isNull() | b.isNull(), -1).otherwise(_first_difference(a, b))
        return F.when(x["section"] >= 0, F.struct(x["section"].alias("section"), x["at"].alias("paragraph"), at.alias("leaf")))

    return F.get(F.transform(F.transform(both, paragraph), leaf), F.lit(0))


def _first_difference(a: Column, b: Column) -> Column:
    """Place from 0 of the first children that differ, -1 if none do; a missing child differs from any."""
    return (F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1).cast("int")


_NODE = ("section", "paragraph", "leaf")


def edits(pairs: DataFrame, id_col: str = "doc_id", before: str = "before", after: str = "after") -> DataFrame:
    """(id, level, kind, place_before, place_after) of every branch in which two texts of a row differ.

    Children of a branch are matched by digest, the n-th copy with the n-th, wherever they stand. One
    that stands in another order among the matched is ``moved``. What matches nothing is paired in
    order: a pair is ``changed`` and followed to its children (a changed leaf is reported), the rest
    is ``removed`` or ``inserted`` with all below it. Places count from 0 on each level, arrays from
    the section down; a side without the branch has null. Two texts give no row only if they are
    equal. ``id_col`` tells rows apart; a null text counts as empty, further columns are left out.
    """
    trees = pairs.select(F.col(id_col).alias("id"), leaf_digests(F.col(before)).alias("a"), leaf_digests(F.col(after)).alias("b"))
    none = F.array().cast("array<int>")
    nodes = trees.where(root(F.col("a")) != root(F.col("b"))).select("id", none.alias("pa"), none.alias("pb"), "a", "b")
    found = []
    for level, digest in zip(_NODE, (_section, _paragraph, lambda leaf: leaf)):
        report, nodes = _compared(nodes, level, digest)
        found.append(report)
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.withColumnRenamed("id", id_col)


def _compared(nodes: DataFrame, level: str, digest) -> tuple[DataFrame, DataFrame]:
    """Edits among the children of changed nodes, and the pairs of children to follow."""
    parent = ["id", "pa", "pb"]

    def children(side: str) -> DataFrame:
        rows = nodes.select(*parent, F.posexplode(side).alias("at", side))
        rows = rows.withColumn("digest", digest(F.col(side)))
        nth = F.row_number().over(Window.partitionBy(*parent, "digest").orderBy("at"))
        return rows.withColumn("nth", nth).withColumnRenamed("at", f"at_{side}")

    joined = children("a").join(children("b"), [*parent, "digest", "nth"], "full")
    same = joined.where(F.col("at_a").isNotNull() & F.col("at_b").isNotNull())
    order = [F.row_number().over(Window.partitionBy(*parent).orderBy(f"at_{side}")) for side in "ab"]
    moved = same.withColumn("ra", order[0]).withColumn("rb", order[1]).where("ra <> rb").select(*parent, "at_a", "at_b", F.lit("moved").alias("kind"))

    def alone(side: str, other: str) -> DataFrame:
        rows = joined.where(F.col(f"at_{other}").isNull()).select(*parent, f"at_{side}", side)
        return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*parent).orderBy(f"at_{side}")))

    paired = alone("a", "b").join(alone("b", "a"), [*parent, "turn"], "full")
    kind = F.when(F.col("at_b").isNull(), "removed").when(F.col("at_a").isNull(), "inserted").otherwise("changed")
    paired = paired.withColumn("kind", kind)
    reported = paired if level == _NODE[-1] else paired.where("kind <> 'changed'")
    places = {f"place_{name}": F.when(F.col(f"at_{s}").isNotNull(), F.array_append(f"p{s}", F.col(f"at_{s}"))) for s, name in (("a", "before"), ("b", "after"))}
    report = reported.select(*parent, "at_a", "at_b", "kind").unionByName(moved)
    report = report.select("id", F.lit(level).alias("level"), "kind", *[c.alias(n) for n, c in places.items()])
    followed = paired.where("kind = 'changed'")
    return report, followed.select("id", *[F.array_append(f"p{s}", F.col(f"at_{s}")).alias(f"p{s}") for s in "ab"], "a", "b")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each row's text, of an edit of it, how alike they and the next text are, and the first edited branch.

    The edit replaces the last half of a text (rounded down) by as many characters, or all, from
    the start of the document with the next larger id; the first follows the last, and a lone
    document follows itself. Ids are integers; a null id counts as the largest of 64 bits, which
    stands for it, and a null text as empty. Where
    an id repeats, each row is fingerprinted, and the row with the smallest start stands for the
    id as a successor. An empty table gives no rows.
    """
    folder = new_folder(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("_key"), text_or_empty(text_col).alias("_text"))
    ids = texts.groupBy("_key").agg(F.max(F.char_length("_text")).alias("n"))
    order = keep(positions(ids, "_key", folder, "ids"), folder, "order")
    total = order.count()
    follows = order.select(
        F.col("_key").alias("before"),
        F.floor(F.col("n") / 2).cast("int").alias("half"),
        F.expr(f"pmod(position + 1, {max(total, 1)})").alias("position"),
    )
    sent = keep(order.select("_key", "position").join(follows, "position").drop("position"), folder, "successors")
    leaves = leaf_digests(F.col("_text"))
    # Both uses of the texts shuffle the same two columns by the same key, so Spark does it once.
    heads = (
        texts.join(sent, "_key")
        .select("before", F.expr("substring(_text, 1, half)").alias("head"), leaves.alias("leaves"))
        .select("before", F.struct("head", root(F.col("leaves")).alias("root"), leaf_numbers(F.col("leaves")).alias("numbers")).alias("next"))
        .groupBy("before")
        .agg(F.min("next").alias("next"))
    )
    own = texts.join(heads, texts["_key"] == heads["before"])
    own = own.withColumn("_id", F.when(F.col("_key") != _LAST_ID, F.col("_key")).cast(kind)).withColumn("n_chars", F.char_length("_text"))
    own = own.withColumn("cut", F.floor(F.col("n_chars") / 2).cast("int"))
    own = own.withColumn("edited", F.expr("concat(substring(_text, 1, n_chars - cut), substring(next.head, 1, cut))"))
    own = own.select("_id", "n_chars", "next", F.sha2("edited", 256).alias("edited_sha256"), leaves.alias("l0"), leaf_digests(F.col("edited")).alias("l1"))
    own = own.select(
        "_id",
        "n_chars",
        "edited_sha256",
        root(F.col("l0")).alias("fingerprint"),
        root(F.col("l1")).alias("edited_fingerprint"),
        leaf_numbers(F.col("l0")).alias("a"),
        leaf_numbers(F.col("l1")).alias("b"),
        first_edit(F.col("l0"), F.col("l1")).alias("edit"),
        "next",
    )
    return own.select(
        F.col("_id").alias(id_col),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("a"), F.col("fingerprint"), F.col("b"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("a"), F.col("fingerprint"), F.col("next.numbers"), F.col("next.root")).alias("near_next"),
        *[F.col(f"edit.{level}").alias(f"edit_{level}") for level in _NODE],
    )
