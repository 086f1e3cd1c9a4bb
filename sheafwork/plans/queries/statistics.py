"""Length statistics over whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheafwork.functions.text import words
from sheafwork.operators import filters, stats
from sheafwork.plans import corpus, sql
from sheafwork.plans.registry import query
from sheafwork.sources import tables

SIDES = f"""{sql.SUMMARIES}, sides AS (
  SELECT 'input' AS side, len({sql.words('text')}) AS n FROM summaries WHERE text <> '' AND summary <> ''
  UNION ALL SELECT 'target', len({sql.words('summary')}) FROM summaries WHERE text <> '' AND summary <> '')"""
NAMES = ["shortest", *[f"p{p}" for p in stats.PERCENTILES], "longest"]
LENGTHS = f"lengths AS (SELECT source AS task, len({sql.words('text')}) AS n FROM documents)"


def sides(spark, sf_dir):
    """(side, n): lengths of both sides of every complete pair, read in one scan."""
    pairs = filters.drop_incomplete_pairs(corpus.summaries(spark, sf_dir))
    both = F.array(
        F.struct(F.lit("input").alias("side"), F.size(words(F.col("text"))).alias("n")),
        F.struct(F.lit("target").alias("side"), F.size(words(F.col("summary"))).alias("n")),
    )
    return pairs.select(F.inline(both))


def lengths(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return docs.select(F.col("source").alias("task"), F.size(words(F.col("text"))).alias("n"))


@query(
    "a1_length_percentiles",
    f"""WITH {SIDES}, r AS (SELECT side, list_concat([min(n)::DOUBLE],
      list_transform(quantile_cont(n, {[p / 100 for p in stats.PERCENTILES]}), lambda v: round_even(v, 1)), [max(n)::DOUBLE]) AS v
      FROM sides GROUP BY side)
    SELECT side, unnest({NAMES}) AS statistic, unnest(v) AS value FROM r""",
)
def length_percentiles(spark, sf_dir):
    return stats.length_percentiles(sides(spark, sf_dir), groups=["side"])


@query("a2_length_percentiles_approx")
def length_percentiles_approx(spark, sf_dir):
    return stats.length_percentiles_approx(sides(spark, sf_dir), groups=["side"])


SOURCED = f"""{sql.SUMMARIES}, sourced AS (
  SELECT 'input' AS side, len({sql.words('text')}) AS n FROM summaries UNION ALL SELECT 'target', len({sql.words('summary')}) FROM summaries)"""


@query(
    "a2_length_sketches",
    f"""WITH {SOURCED}, r AS (SELECT side, list_concat([min(n)::DOUBLE],
      list_transform(quantile_disc(n, {[p / 100 for p in stats.PERCENTILES]}), lambda v: v::DOUBLE), [max(n)::DOUBLE]) AS v FROM sourced GROUP BY side)
    SELECT side, unnest({NAMES}) AS statistic, unnest(v) AS value FROM r""",
)
def length_sketches(spark, sf_dir):
    """One stored sketch for each side and source; the report merges them and reads no text.

    Equal to the SQL while a side has at most ``stats.SKETCH_SIZE`` rows, near it beyond.
    """
    rows = corpus.summaries(spark, sf_dir)
    lengths_of = [F.struct(F.lit(side).alias("side"), F.size(words(F.col(c))).alias("n")) for side, c in (("input", "text"), ("target", "summary"))]
    parts = stats.length_sketches(rows.select("title", F.inline(F.array(*lengths_of))), groups=["side", "title"])
    path = f"{tables.shared_dir(spark)}/sketches-{uuid.uuid4().hex}"
    parts.write.parquet(path)
    stored = spark.read.schema(parts.schema).parquet(path)
    return stats.sketched_percentiles(stats.merge_sketches(stored, ["side"]), groups=["side"])


@query("a3_share_below", f"WITH {LENGTHS} SELECT task, round(avg((n < 512)::INT), 6) AS share FROM lengths GROUP BY task")
def share_below(spark, sf_dir):
    return stats.share_below(lengths(spark, sf_dir), 512, groups=["task"]).withColumn("share", F.round("share", 6))


@query("a4_row_count", "SELECT source AS task, count(*) AS n_rows FROM documents GROUP BY source")
def row_count(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("source").alias("task"))
    return stats.row_count(docs, ["task"])


@query(
    "a5_truncation_loss",
    f"""WITH {LENGTHS} SELECT task, round(avg((n > 512)::INT), 6) AS rows_cut,
    round(sum(greatest(n - 512, 0)) / sum(n), 6) AS ids_cut FROM lengths GROUP BY task""",
)
def truncation_loss(spark, sf_dir):
    report = stats.truncation_loss(lengths(spark, sf_dir), 512, groups=["task"])
    return report.withColumns({c: F.round(c, 6) for c in ("rows_cut", "ids_cut")})
