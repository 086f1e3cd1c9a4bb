"""URLs kept or refused by a ratio of two character models.

Rules decide the URLs that they fit. From these, two Markov models of variable order are learned,
one for allowed and one for blocked URLs: a character's probability after its last few characters
is smoothed by the next shorter context, in proportion to how often and with how many different
characters the context was seen (Witten-Bell). The other URLs are allowed if the difference of the
two log-likelihoods, per character, reaches a threshold that held-out ruled URLs calibrate.

Counts are exact and over all ruled URLs. A character with the four before it is five bytes and so one
number, and the counts are a table by these numbers that grows with the URLs. A number says what every
shorter context is, so a table of the numbers that occur gets both models' probabilities by joins
whose keys have at most 256 rows, and the URLs' characters are joined to that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import append, buffer_of, keep, new_folder, pieces, text_or_empty

#: Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDERS = 5  # contexts of 0 to 4 characters
_EDGE = np.uint8(255)  # before and after every URL; no byte of UTF-8
#: A number with more than this share of all characters is looked up where the URL is read; there are at most
#: ``1 / OFTEN`` of them. The other numbers are joined, so no key of that join has a larger share.
OFTEN = 1 / (1 << 16)
ONE = 1 << 30  # logarithms are added up as whole parts of this, so sums do not depend on the order of rows
BINS = 2000
SCALE = 5.0  # differences per character are taken as within -SCALE to SCALE


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does; of equally long, the first.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    text = verdict = F.lit(None).cast("string")
    # The chain is built from the shortest rule up, so the longest is asked first.
    for own, start, says in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        text = F.when(fits, F.lit(own + start)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every character and the end of each URL with the ``ORDERS - 1`` bytes before it as one number, and URLs' numbers.

    The last byte of a number is the character, the one above it the byte before it. Every URL ends with
    an edge; before its start lie edges.
    """
    raw, at = buffer_of(texts)
    n, size = len(texts), np.diff(at)
    pad = ORDERS  # edges before each URL, one of them also its predecessor's end
    start = at[:-1] + (np.arange(n) + 1) * pad
    line = np.full(int(at[-1]) + (n + 1) * pad, _EDGE, np.uint8)
    line[np.arange(len(raw)) + np.repeat(start - at[:-1], size)] = raw
    # Predicted characters: the URL's own and the edge behind it.
    own = np.repeat(start - np.cumsum(np.concatenate(([0], size[:-1] + 1))), size + 1) + np.arange(int(size.sum()) + n)
    found = np.zeros(len(own), np.int64)
    for k in range(ORDERS):
        found |= line[own - k].astype(np.int64) << (8 * k)
    return found, np.repeat(np.arange(n), size + 1)


def gram_counts(df: DataFrame, text_col: str, weights: dict[str, Column]) -> DataFrame:
    """``gram`` and, for each of ``weights``, its sum over all places of the gram. Added up in each task first."""
    names = list(weights)

    def run(batches):
        for batch in pieces(batches, "_text", 1 << 18):
            gram, which = grams(batch.column("_text"))
            gram, place = np.unique(gram, return_inverse=True)
            sums = [np.bincount(place, np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float)[which], len(gram)) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(gram), *(pa.array(x.astype(np.int64)) for x in sums)], names=["gram", *names])

    rows = df.select(text_or_empty(text_col).alias("_text"), *(w.cast("int").alias(c) for c, w in weights.items()))
    counts = rows.mapInArrow(run, ", ".join(f"`{c}` long" for c in ["gram", *names]))
    return counts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in names))


def log_ratios(counts: DataFrame, fits: dict[str, tuple[str, str]], folder: str) -> DataFrame:
    """Add to each gram, for each of ``fits``, its log-probability as allowed minus as blocked, in parts of ``ONE``.

    ``fits`` has the columns of ``counts`` with the blocked and the allowed URLs' counts. A context is followed
    by at most 256 characters and has at most 256 longer ones, so neither the windows nor the joins
    have a key with more rows.
    """
    classes = [c for pair in fits.values() for c in pair]
    short = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _shortened("gram", k).alias("gram")) for k in range(ORDERS))))
    levels = counts.select(short.alias("_"), *classes).groupBy("_.k", "_.gram").agg(*(F.sum(c).alias(c) for c in classes))
    after = Window.partitionBy("k", F.shiftright("gram", 8))
    seen = {f"{c}_seen": F.sum(c).over(after) for c in classes}
    kinds = {f"{c}_kinds": F.sum((F.col(c) > 0).cast("long")).over(after) for c in classes}
    levels = keep(levels.withColumns(seen | kinds), folder, "levels")
    known = None
    for k in range(ORDERS):
        level = levels.where(F.col("k") == k)
        if known is None:
            level = level.withColumns({f"{c}_p": F.lit(1 / 256.0) for c in classes})
        else:
            level = level.join(known.withColumnRenamed("gram", "_shorter"), _shortened("gram", k - 1) == F.col("_shorter"))
        known = level.select("gram", *(_smoothed(c).alias(f"{c}_p") for c in classes))
    ratio = lambda zero, one: F.round((F.log(f"{one}_p") - F.log(f"{zero}_p")) * ONE).cast("long")
    ratios = known.select("gram", *(ratio(*pair).alias(out) for out, pair in fits.items()))
    return counts.select("gram", "n").join(ratios, "gram")


def _shortened(gram: str, k: int) -> Column:
    """The gram with its nearest ``k`` bytes of context only."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))


def _smoothed(c: str) -> Column:
    n, seen, kinds, p = (F.col(c + x) for x in ("", "_seen", "_kinds", "_p"))
    return F.when(seen > 0, (n + kinds * p) / (seen + kinds)).otherwise(p)


def differences(df: DataFrame, text_col: str, ratios: DataFrame, outs: Sequence[str], folder: str) -> DataFrame:
    """Add the sums of ``outs`` over each text's grams, per character with the end.

    ``df`` has a column ``_row`` that tells its rows apart; ``ratios`` has all grams of the texts.
    """
    total = ratios.agg(F.sum("n")).first()[0] or 0
    often = ratios.where(F.col("n") > total * OFTEN).select("gram", *outs).toArrow().sort_by("gram")
    table = [often.column(c).to_numpy() for c in ("gram", *outs)]
    shipped = df.sparkSession.sparkContext.broadcast([np.append(t, -1 if i == 0 else 0) for i, t in enumerate(table)])

    def prepare():
        codes, *values = shipped.value  # the last one, -1, stands for all that are not there

        def work(texts: pa.Array) -> list[pa.Array]:
            gram, which = grams(texts)
            at = np.searchsorted(codes[:-1], gram)
            rare = codes[at] != gram
            at[rare] = len(codes) - 1
            sums = []
            for v in values:
                upto = np.concatenate(([0], np.cumsum(v[at])))
                ends = np.searchsorted(which, np.arange(len(texts) + 1))
                sums.append(pa.array(upto[ends[1:]] - upto[ends[:-1]]))
            cuts = np.searchsorted(which[rare], np.arange(len(texts) + 1)).astype(np.int32)
            return [pa.array(np.bincount(which, minlength=len(texts))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(gram[rare])), *sums]

        return work

    fields = ", ".join(["_size long", "_rare array<long>", *(f"`{c}` long" for c in outs)])
    begun = keep(append(df, text_col, fields, prepare, 1 << 18), folder, "begun")
    rare = begun.select("_row", F.explode("_rare").alias("gram")).join(ratios.select("gram", *outs), "gram")
    rest = rare.groupBy("_row").agg(*(F.sum(c).alias(f"_{c}") for c in outs))
    whole = {c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))) / F.lit(float(ONE)) / F.col("_size") for c in outs}
    return begun.join(rest, "_row", "left").withColumns(whole).drop("_size", "_rare", *(f"_{c}" for c in outs))


@dataclass
class Model:
    """Both classes' counts by gram."""

    counts: DataFrame

    def difference(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihood as allowed minus as blocked, per character with the end, of texts at the driver."""
        spark = self.counts.sparkSession
        folder = new_folder(spark)
        asked = spark.createDataFrame(list(enumerate(texts.to_pylist())), "_row long, text string")
        own = gram_counts(asked, "text", {"n": F.lit(1)}).withColumns({"blocked": F.lit(0), "allowed": F.lit(0)})
        counts = own.unionByName(self.counts.withColumn("n", F.lit(0))).groupBy("gram").agg(*(F.sum(c).alias(c) for c in own.columns[1:]))
        ratios = keep(log_ratios(keep(counts, folder, "counts"), {"difference": ("blocked", "allowed")}, folder), folder, "ratios")
        got = differences(asked, "text", ratios, ["difference"], folder).select("_row", "difference").toArrow().sort_by("_row")
        return got.column("difference").to_numpy()


def learn(ruled: DataFrame, text_col: str = "text", label_col: str = "label") -> Model:
    """Both models from ``label`` 1 (allowed) and 0 (blocked), as a table."""
    label = F.col(label_col)
    return Model(gram_counts(ruled, text_col, {"blocked": label == 0, "allowed": label == 1}))


def threshold(scored: DataFrame, label: str = "label", value: str = "difference") -> float:
    """The difference from which on held-out allowed and blocked URLs are told apart best.

    Balanced accuracy over ``BINS`` bins; of equally good ones the middle. Without held-out URLs of both
    classes it is 0.
    """
    bin_of = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col(value) + SCALE) / (2 * SCALE) * BINS))).cast("int")
    table = np.zeros((2, BINS))
    for row in scored.groupBy(F.col(label).alias("l"), bin_of.alias("b")).count().collect():
        table[row["l"], row["b"]] = row["count"]
    if not table.sum(1).all():
        return 0.0
    share = table / table.sum(1, keepdims=True)
    refused = np.concatenate(([0], np.cumsum(share[0])))
    kept = 1 - np.concatenate(([0], np.cumsum(share[1])))
    good = np.flatnonzero(np.isclose(refused + kept, (refused + kept).max()))
    return float(good[len(good) // 2] / BINS * 2 * SCALE - SCALE)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, difference`` for every row.

    A URL that is null or has no ``://`` has an empty host and path; like every URL without a rule it gets
    the models' verdict. The models read whole URLs, with scheme, query and fragment; null is empty. A fifth of the ruled URLs (by a hash of the URL) is held out for the
    threshold; after that the models are learned from all ruled URLs. Repeated rows are judged alike;
    without ruled URLs all differences are 0 and all are allowed.
    """
    folder = new_folder(pages.sparkSession)
    base = pages.select(F.col(id_col).alias("_id"), text_or_empty(url_col).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict})
    base = keep(base.withColumn("_row", F.monotonically_increasing_id()), folder, "urls")
    held_out = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    blocked, allowed = (F.coalesce(F.col("ruled") == x, F.lit(False)) for x in ("block", "allow"))
    weights = {"n": F.lit(1), "blocked": blocked, "allowed": allowed, "some_blocked": blocked & ~held_out, "some_allowed": allowed & ~held_out}
    counts = keep(gram_counts(base, "url", weights), folder, "counts")
    fits = {"difference": ("blocked", "allowed"), "_tried": ("some_blocked", "some_allowed")}
    ratios = keep(log_ratios(counts, fits, folder), folder, "ratios")
    judged = keep(differences(base, "url", ratios, list(fits), folder), folder, "judged")
    known = judged.where(held_out & F.col("ruled").isNotNull())
    limit = threshold(known.select(allowed.cast("int").alias("label"), F.col("_tried").alias("difference")))
    says = F.when(F.col("difference") >= limit, "allow").otherwise("block")
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", says).alias("verdict"), "difference")
