"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. Its documents get rates between 0 and ``most`` copies
that are as close to even as entropy allows and meet the target: an exponential tilt in the
document's size, bounded above. The dual has one unknown for each source and is convex; Newton
steps on it are sums over the (source, size) classes that Spark adds up. The rates are then
rounded to whole copies so that the running sum over documents ordered by size never strays by
more than one copy, which keeps the words taken within about one document of the target.
"""

from __future__ import annotations

import uuid

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import keep, new_folder, positions, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: A class of equal documents is numbered in so many parts, so that no task numbers a large class alone.
PARTS = 4096
STEPS = 60
SHIFTS = 16


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float, folder: str) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row for each source.

    Sources in code point order, null last, take the weights in turn. ``share`` times all words
    are dealt by weight; a target stops at ``most`` times its source's words and the excess is
    dealt again among the others, until none is above.
    """
    if share > most:
        raise ValueError("the share can't be above what the sources may give")
    keyed = sources.withColumn("_order", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))))
    ranked = positions(keyed, "_order", folder, "source-ranges")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("position") % len(weights)).cast("int") + 1)
    open_ = keep(ranked.select("source", "source_size", weight.alias("weight")), folder, "weights")
    capped, full = most * F.col("source_size"), F.lit(False)
    total = share * (open_.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        # Two sums decide the level at which the weights meet what is left to deal.
        given, left = open_.agg(F.sum(F.when(full, capped)), F.sum(F.when(~full, F.col("weight")))).first()
        if not left:
            break
        level = (total - (given or 0.0)) / left
        now = full | (F.col("weight") * F.lit(level) > capped)
        if not open_.where(now & ~full).limit(1).count():
            break
        full = F.col("weight") * F.lit(level) > capped
    return open_.select("source", "source_size", F.when(full, capped).otherwise(F.col("weight") * F.lit(level)).cast("double").alias("target"))


def _rate(tilt: Column, x: Column, most: float) -> Column:
    """``most * exp(tilt x) / (1 + exp(tilt x))``: no tilt gives ``most / 2``, and no rate passes ``most``."""
    z = tilt * x
    positive = F.lit(most) / (F.lit(1.0) + F.exp(-z))
    e = F.exp(z)
    return F.when(z >= 0, positive).otherwise(F.lit(most) * e / (F.lit(1.0) + e))


def tilts(classes: DataFrame, goals: DataFrame, most: float, folder: str, close: float = 1e-9) -> DataFrame:
    """``source, target, unit, tilt, whole`` that solve ``sum(size * rate) = target`` for every source.

    ``classes`` has ``source, size, n``; ``goals`` has ``source, source_size, target``. Newton's
    method inside a bracket: a step that leaves the bracket is replaced by its middle. ``whole`` marks
    sources whose target is all they may give, where the rate is ``most`` for every document.
    """
    docs = classes.groupBy("source").agg(F.sum("n").alias("docs"))
    same = F.col("g.source").eqNullSafe(F.col("d.source"))
    state = goals.alias("g").join(docs.alias("d"), same).select("g.source", "g.source_size", "g.target", "d.docs")
    whole = (F.col("source_size") > 0) & (F.col("target") >= most * F.col("source_size"))
    unit = F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs"))
    state = state.select(
        "source", "target", whole.alias("whole"), unit.alias("unit"), F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")
    )
    state = keep(state, folder, "tilt-0")
    for step in range(1, STEPS + 1):
        x = F.col("c.size") / F.col("s.unit")
        rate = _rate(F.col("s.tilt"), x, most)
        joined = state.where(~F.col("whole")).alias("s").join(classes.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")))
        sums = joined.groupBy(F.col("s.source").alias("at")).agg(
            F.sum(F.col("n") * F.col("c.size") * rate).alias("got"),
            F.sum(F.col("n") * F.col("c.size") * x * rate * (1 - rate / F.lit(most))).alias("slope"),
        )
        gap = F.col("target") - F.col("got")
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("at")), "left")
        low = F.when(gap > 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(gap <= 0, F.least("high", "tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + F.when(F.col("slope") > 0, gap / F.col("slope")).otherwise(F.signum(gap))
        inside = (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
        middle = F.when(F.col("low").isNull(), 2 * F.col("high") - 1).when(F.col("high").isNull(), 2 * F.col("low") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        off = F.abs(gap) / F.greatest(F.lit(1.0), F.col("target"))
        moved = moved.withColumn("low", low).withColumn("high", high)
        moved = moved.select(
            "source",
            "target",
            "whole",
            "unit",
            F.when(F.col("got").isNull() | (off <= close), F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"),
            "low",
            "high",
            off.alias("off"),
        )
        moved = keep(moved, folder, f"tilt-{step}")
        state = moved.drop("off")
        if not (moved.agg(F.max("off")).first()[0] or 0) > close:
            break
    # Sums of doubles may differ in their last bits from run to run; the tilt that is used does not.
    return state.select("source", "unit", F.round("tilt", 7).alias("tilt"), "whole")


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """One row for each input row: ``row_id``, id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` counts words (null text: 0), ``taken = size * copies`` and ``copies <= most``. A null
    source is a source of its own, the last. A document without words meets no target; it gets
    copies as its tilt says (about one). Repeated ids and rows are documents of their own. The result
    depends on the rows alone, so reruns agree; an empty table gives no rows.
    """
    folder = new_folder(docs.sparkSession)
    rows = keep(
        docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")),
        folder,
        "sizes",
    )
    part = F.pmod(F.xxhash64("_id", "size"), F.lit(PARTS)).cast("int")
    # Totals of sources, classes and parts are pre-added in every task, so a hot source costs no more than another.
    parts = keep(rows.groupBy("source", "size", part.alias("part")).agg(F.count("*").alias("n")), folder, "parts")
    classes = keep(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), folder, "classes")
    goals = keep(targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most, folder), folder, "targets")
    solved = tilts(classes, goals, most, folder)
    g, s, c = goals.alias("g"), solved.alias("s"), classes.alias("c")
    rated = c.join(g, F.col("c.source").eqNullSafe(F.col("g.source"))).join(s, F.col("c.source").eqNullSafe(F.col("s.source")))
    rate = F.when(F.col("s.whole"), F.lit(float(most))).otherwise(_rate(F.col("s.tilt"), F.col("c.size") / F.col("s.unit"), most))
    rated = rated.select("c.source", "c.size", "c.n", "g.source_size", "g.target", rate.alias("rate"))
    # Sizes of one source in order: as many rows as it has distinct sizes, however many documents.
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = keep(rated.withColumn("start", F.coalesce(F.sum(F.col("rate") * F.col("n")).over(before), F.lit(0.0))), folder, "rates")
    # Rounding starts at the one of a few places that brings a source nearest to its target.
    tried = rated.withColumn("shift", F.explode(F.array(*(F.lit((j + 0.5) / SHIFTS) for j in range(SHIFTS)))))
    whole_copies = F.floor(F.col("start") + F.col("rate") * F.col("n") + F.col("shift")) - F.floor(F.col("start") + F.col("shift"))
    sums = tried.groupBy("source", "target", "shift").agg(F.sum(F.col("size") * whole_copies).alias("words"))
    nearest = sums.groupBy("source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("off"), "shift")).alias("best"))
    shifts = keep(nearest.select(F.col("source").alias("_source"), F.col("best.shift").alias("shift")), folder, "shifts")
    rated = rated.join(shifts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("o")
    r = rated.alias("r")
    places = offsets.join(r, F.col("o.source").eqNullSafe(F.col("r.source")) & (F.col("o.size") == F.col("r.size")))
    places = keep(
        places.select(
            F.col("o.source").alias("source"), F.col("o.size").alias("size"), "part", "source_size", "target", "rate", (F.col("start") + F.col("rate") * F.col("offset") + F.col("shift")).alias("start")
        ),
        folder,
        "places",
    )
    inside = Window.partitionBy("source", "size", "part").orderBy("_id", "row_id")
    numbered = rows.withColumn("part", part).withColumn("k", F.row_number().over(inside)).alias("d")
    p = places.alias("p")
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.part") == F.col("p.part"))
    until = F.floor(F.col("p.start") + F.col("p.rate") * F.col("d.k"))
    since = F.floor(F.col("p.start") + F.col("p.rate") * (F.col("d.k") - 1))
    count = F.least(F.lit(most).cast("long"), F.greatest(F.lit(0).cast("long"), until - since))
    return numbered.join(p, same).select(
        "d.row_id",
        F.col("d._id").alias(id_col),
        F.col("d.size").alias("size"),
        "p.source_size",
        "p.target",
        count.alias("copies"),
        (F.col("d.size") * count).alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as often as :func:`copies` says, columns as they were.

    Rows of one id, source and number of words share their copies evenly, the first rows by text taking more.
    """
    folder = new_folder(docs.sparkSession)
    counted = copies(docs, id_col, text_col, source_col, **options)
    mark = uuid.uuid4().hex  # for names that the input lacks
    at, size, total, rows, words, turn, own, copy = (f"{c}_{mark}" for c in ("id", "size", "copies", "rows", "words", "turn", "own", "copy"))
    shared = counted.groupBy(F.col(id_col).alias(at), F.col("size").alias(size)).agg(F.sum("copies").alias(total), F.count("*").alias(rows))
    shared = keep(shared, folder, "shared")
    place = F.row_number().over(Window.partitionBy(id_col, words).orderBy(text_col))
    sized = docs.withColumn(words, word_count(F.col(text_col))).withColumn(turn, place)
    every = sized.join(shared, F.col(id_col).eqNullSafe(F.col(at)) & (F.col(words) == F.col(size)))
    due = F.expr(f"cast(floor({total} * {turn} / {rows}) - floor({total} * ({turn} - 1) / {rows}) as int)")
    taken = every.withColumn(own, due).where(F.col(own) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own))))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))
