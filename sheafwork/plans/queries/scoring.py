"""Classification and language-model metrics over prediction tables.

Logits are whole 64-component vectors, so there are 64 classes of which the labels use a few.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions import arrays, scores
from sheafwork.operators import metrics
from sheafwork.plans import corpus
from sheafwork.plans.corpus import NUM_CLASSES
from sheafwork.plans.queries.tables import MULTI_HOT_SQL
from sheafwork.plans.registry import query

LOGITS = "logits AS (SELECT vec_id AS example_id, list_transform(embedding, lambda x: x::DOUBLE) AS s, label FROM embeddings)"
PREDS = f"{LOGITS}, preds AS (SELECT example_id, (list_position(s, list_max(s)) - 1)::INT AS pred, label FROM logits)"
LSE = "ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) + list_max(s)"
COUNTS = f"""{PREDS}, counts AS (
  SELECT class, count(*) FILTER (WHERE hit AND side = 't') AS tp, count(*) FILTER (WHERE NOT hit AND side = 'p') AS fp,
    count(*) FILTER (WHERE NOT hit AND side = 't') AS fn, count(*) FILTER (WHERE side = 't') AS support
  FROM (SELECT label AS class, label = pred AS hit, 't' AS side FROM preds
        UNION ALL SELECT pred, label = pred, 'p' FROM preds) GROUP BY class)"""
TARGET_IDS = """list_filter([e.label, CASE WHEN l.quality = 1 THEN 10 END, CASE WHEN l.toxic = 1 THEN 11 END]::INT[],
  lambda x: x IS NOT NULL)"""
TARGETS = f"""targets AS (
  SELECT e.vec_id AS example_id, list_transform(e.embedding, lambda x: x::DOUBLE) AS s,
    {MULTI_HOT_SQL.format(n=NUM_CLASSES, t=TARGET_IDS)} AS targets
  FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id)"""
CELLS = f"""{TARGETS}, cells AS (
  SELECT (unnest(range({NUM_CLASSES})))::INT AS class,
    unnest(list_transform(s, lambda x: (1 / (1 + exp(-x)) >= 0.5)::INT)) AS p, unnest(list_transform(targets, lambda t: t::INT)) AS t
  FROM targets), per_class AS (
  SELECT class, count(*) FILTER (WHERE p = 1 AND t = 1) AS tp, count(*) FILTER (WHERE p = 1 AND t = 0) AS fp,
    count(*) FILTER (WHERE p = 0 AND t = 1) AS fn FROM cells GROUP BY class)"""


def class_preds(spark, sf_dir):
    rows = corpus.class_preds(spark, sf_dir)
    return rows.withColumn("pred", scores.argmax(F.col("logits")))


def multilabel_preds(spark, sf_dir):
    rows = corpus.multilabel_preds(spark, sf_dir)
    return rows.select("example_id", "logits", arrays.multi_hot(F.col("target_ids"), NUM_CLASSES).alias("targets"))


def multilabel_cells(spark, sf_dir):
    return multilabel_preds(spark, sf_dir).select(
        scores.binarize(F.col("logits")).alias("pred"), scores.targets_to_int(F.col("targets")).alias("target")
    )


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "e0_join_predictions",
    f"""WITH {PREDS} SELECT example_id, pred, quality AS label FROM preds JOIN labels ON doc_id = example_id""",
)
def join_predictions(spark, sf_dir):
    preds = class_preds(spark, sf_dir).select("example_id", "pred")
    targets = corpus.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("example_id"), F.col("quality").alias("label")
    )
    return metrics.join_predictions(preds, targets)


@query(
    "e0_unmatched_rows",
    """SELECT vec_id AS example_id, 'targets' AS missing_from FROM embeddings ANTI JOIN labels ON doc_id = vec_id
    UNION ALL SELECT doc_id, 'preds' FROM labels ANTI JOIN embeddings ON doc_id = vec_id""",
)
def unmatched_rows(spark, sf_dir):
    preds = corpus.class_preds(spark, sf_dir)
    targets = corpus.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "example_id")
    return metrics.unmatched_rows(preds, targets)


@query("e1_argmax", f"WITH {PREDS} SELECT example_id, pred FROM preds")
def argmax(spark, sf_dir):
    return class_preds(spark, sf_dir).select("example_id", "pred")


@query("e2_accuracy", f"WITH {PREDS} SELECT round(avg((pred = label)::INT), 6) AS accuracy FROM preds")
def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(class_preds(spark, sf_dir)), "accuracy")


@query("e3_class_counts", f"WITH {COUNTS} SELECT * FROM counts")
def class_counts(spark, sf_dir):
    return metrics.class_counts(class_preds(spark, sf_dir))


@query("e4_confusion_matrix", f"WITH {PREDS} SELECT label, pred, count(*) AS n FROM preds GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(class_preds(spark, sf_dir))


F1_SQL = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END"


@query(
    "e5_macro_f1",
    f"""WITH {COUNTS} SELECT round(avg({F1_SQL}), 6) AS skip, round(sum({F1_SQL}) / {NUM_CLASSES}, 6) AS zero FROM counts""",
)
def macro_f1(spark, sf_dir):
    """Both rules for classes that no row has or predicts."""
    counts = metrics.class_counts(class_preds(spark, sf_dir))
    rules = [
        metrics.macro_f1_of_counts(counts, NUM_CLASSES, absent).select(F.lit(absent).alias("rule"), "macro_f1")
        for absent in ("skip", "zero")
    ]
    both = metrics.eval_union(*rules)
    values = [F.max(F.when(F.col("rule") == r, F.round("macro_f1", 6))).alias(r) for r in ("skip", "zero")]
    return both.agg(*values)


@query(
    "e6_multilabel_binarize",
    f"WITH {LOGITS} SELECT example_id, list_transform(s, lambda x: (1 / (1 + exp(-x)) >= 0.5)::INT) AS pred FROM logits",
)
def multilabel_binarize(spark, sf_dir):
    rows = corpus.class_preds(spark, sf_dir)
    return rows.select("example_id", scores.binarize(F.col("logits")).alias("pred"))


@query(
    "e7_float_targets_to_int",
    f"WITH {TARGETS} SELECT example_id, list_transform(targets, lambda t: t::INT) AS targets FROM targets",
)
def float_targets_to_int(spark, sf_dir):
    rows = multilabel_preds(spark, sf_dir)
    return rows.select("example_id", scores.targets_to_int(F.col("targets")).alias("targets"))


@query("e8_multilabel_accuracy", f"WITH {CELLS} SELECT round(avg((p = t)::INT), 6) AS accuracy FROM cells")
def multilabel_accuracy(spark, sf_dir):
    return rounded(metrics.multilabel_accuracy(multilabel_cells(spark, sf_dir)), "accuracy")


@query("e8_multilabel_macro_f1", f"WITH {CELLS} SELECT round(avg({F1_SQL}), 6) AS macro_f1 FROM per_class")
def multilabel_macro_f1(spark, sf_dir):
    return rounded(metrics.multilabel_macro_f1(multilabel_cells(spark, sf_dir), NUM_CLASSES), "macro_f1")


@query("e9_cross_entropy", f"WITH {LOGITS} SELECT round(avg({LSE} - s[label + 1]), 6) AS cross_entropy FROM logits")
def cross_entropy(spark, sf_dir):
    return rounded(metrics.cross_entropy(corpus.class_preds(spark, sf_dir)), "cross_entropy")


BCE_CELLS = f"""{TARGETS}, flat AS (SELECT unnest(s) AS x, unnest(targets)::DOUBLE AS t FROM targets),
losses AS (SELECT greatest(x, 0) - x * t + ln(1 + exp(-abs(x))) AS loss FROM flat)"""


@query("e10_bce_with_logits", f"WITH {BCE_CELLS} SELECT round(avg(loss), 6) AS bce FROM losses")
def bce_with_logits(spark, sf_dir):
    return rounded(metrics.bce_with_logits(multilabel_preds(spark, sf_dir)), "bce")


@query("e10_bce_with_logits_sum", f"WITH {BCE_CELLS} SELECT round(sum(loss), 4) AS bce FROM losses")
def bce_with_logits_sum(spark, sf_dir):
    total = metrics.bce_with_logits(multilabel_preds(spark, sf_dir), "sum")
    return total.withColumn("bce", F.round("bce", 4))


@query(
    "e11_lm_cross_entropy",
    f"""WITH t AS (SELECT vec_id // 5 AS example_id, vec_id % 5 AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS s,
      lead(label) OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS target FROM embeddings)
    SELECT round(avg({LSE} - s[target + 1]), 6) AS cross_entropy FROM t WHERE target IS NOT NULL""",
)
def lm_cross_entropy(spark, sf_dir):
    logits, labels = corpus.token_preds(spark, sf_dir)
    return rounded(metrics.lm_cross_entropy(logits, labels), "cross_entropy")
