"""Scans, catalogs, projections, filters and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheafwork.functions.arrays import multi_hot
from sheafwork.functions.text import words
from sheafwork.operators import encoding, filters, labels, sampling
from sheafwork.plans import corpus, sql
from sheafwork.plans.registry import query
from sheafwork.sources import catalog, features, tables

CATALOG_SQL = "task_catalog(task, example_type, col0, col1, col2) AS (VALUES {})".format(
    ", ".join(
        "('{}', '{}', {}, '{}', '{}')".format(t, k, f"'{c[0]}'" if c[0] else "NULL", c[1], c[2])
        for t, k in catalog.TASK_TYPES.items()
        for c in [catalog.EXAMPLE_COLUMNS[k]]
    )
)
LABELS_SQL = "label_catalog(task, label_id, label_name) AS (VALUES {})".format(
    ", ".join(f"('{t}', {i}, '{name}')" for t, names in catalog.TASK_LABELS.items() for i, name in enumerate(names))
)


@query(
    "s1_scan_split",
    "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE source = 'src3' AND lang = 'en'",
)
def scan_split(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    return tables.scan_split(docs, "src3", "en", task_col="source", split_col="lang")


@query(
    "s1_scan_folders",
    f"""WITH {sql.ADDRESSED}, {CATALOG_SQL} SELECT example_id, a.task, split, text FROM addressed a
    JOIN task_catalog c ON c.task = a.task AND c.example_type = 'multi_class' WHERE split = 'train'""",
)
def scan_folders(spark, sf_dir):
    """The training split of every multi-class task of the catalog, from a table in folders by task and split."""
    path = f"{tables.shared_dir(spark)}/addressed-{uuid.uuid4().hex}"
    rows = corpus.addressed(corpus.documents(spark, sf_dir)).select("example_id", "text", "task", "split")
    features.write_features(rows, path, ["task", "split"])
    stored = spark.read.schema(rows.schema).parquet(path)
    return tables.scan_listed(stored, multi_class_training(spark)).select("example_id", "task", "split", "text")


def multi_class_training(spark):
    tasks = catalog.task_catalog(spark).where(F.col("example_type") == "multi_class")
    return tasks.select("task", F.lit("train").alias("split"))


@query(
    "s2_normalize_split",
    f"""WITH {sql.ADDRESSED}
    SELECT example_id, task, CASE WHEN task <> 'billsum' OR split = 'train' THEN split ELSE 'test' END AS split
    FROM addressed""",
)
def normalize_split(spark, sf_dir):
    rows = corpus.addressed(corpus.table(spark, sf_dir, "documents"))
    split = tables.normalize_split(F.col("split"), F.col("task") == "billsum")
    return rows.select("example_id", "task", split.alias("split"))


@query(
    "s3_materialize_features",
    f"""WITH {sql.VOCAB}, toks AS (SELECT doc_id AS example_id, {sql.words('text')} AS tokens FROM documents),
    {sql.encoded('toks', 'tokens', 'input_ids', 'enc')}
    SELECT example_id, input_ids FROM enc""",
)
def materialize_features(spark, sf_dir):
    """Encode once, write to the shared folder, read the written table."""
    vocab = corpus.vocabulary(spark, sf_dir)
    rows = corpus.documents(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"), words(F.col("text")).alias("tokens")
    )
    encoded = encoding.encode(rows, vocab, {"tokens": "input_ids"}).select("example_id", "input_ids")
    key = f"features_{spark.sparkContext.applicationId}"
    return features.materialize_features(encoded, tables.shared_dir(spark), key, sources=[f"{sf_dir}/documents.parquet"], stale="rewrite")


@query(
    "s4_cache_key",
    f"""WITH {sql.ADDRESSED}, clean AS (
      SELECT *, list_filter(string_split(regexp_replace(tokenizer, '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws
      FROM addressed)
    SELECT 'cached_' || split || '_'
      || list_aggregate(list_transform(ws, lambda w: upper(w[1]) || substr(w, 2)), 'string_agg', '')
      || '_512_' || task AS cache_key, count(*) AS n_rows
    FROM clean GROUP BY 1""",
)
def cache_key(spark, sf_dir):
    rows = corpus.addressed(corpus.table(spark, sf_dir, "documents"))
    key = features.cache_key(F.col("split"), F.col("tokenizer"), F.lit(512), F.col("task"))
    return rows.groupBy(key.alias("cache_key")).agg(F.count("*").alias("n_rows"))


@query(
    "s5_write_features",
    f"""WITH {sql.SUMMARIES} SELECT example_id, {sql.words('text')} AS tokens, title FROM summaries""",
)
def write_features(spark, sf_dir):
    """Typed arrays of whole bodies written in folders by title, then read back."""
    rows = corpus.summaries(spark, sf_dir).select("example_id", words(F.col("text")).alias("tokens"), "title")
    name = f"tokens_{spark.sparkContext.applicationId}_{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"
    path = f"{tables.shared_dir(spark)}/{name}"
    features.write_features(rows, path, ["title"])
    return tables.read_table(spark, path).select(*rows.columns)


@query(
    "s6_task_catalog",
    f"""WITH {sql.ADDRESSED}, {CATALOG_SQL}
    SELECT task, example_type, col0, col1, col2, count(*) AS n_rows
    FROM addressed JOIN task_catalog USING (task) GROUP BY ALL""",
)
def task_catalog(spark, sf_dir):
    rows = corpus.addressed(corpus.table(spark, sf_dir, "documents")).groupBy("task").agg(F.count("*").alias("n_rows"))
    return rows.join(F.broadcast(catalog.task_catalog(spark)), "task").select(
        "task", "example_type", "col0", "col1", "col2", "n_rows"
    )


@query(
    "s7_label_catalog",
    f"""WITH {LABELS_SQL}
    SELECT task, label_id, label_name, coalesce(n, 0) AS n_rows
    FROM label_catalog LEFT JOIN (SELECT label AS label_id, count(*) AS n FROM embeddings GROUP BY 1) USING (label_id)""",
)
def label_catalog(spark, sf_dir):
    """Every catalog label with the number of vectors that carry its id."""
    counts = (
        corpus.table(spark, sf_dir, "embeddings")
        .groupBy(F.col("label").alias("label_id"))
        .agg(F.count("*").alias("n"))
    )
    return (
        catalog.label_catalog(spark)
        .join(counts, "label_id", "left")
        .select("task", "label_id", "label_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"))
    )


MARKS_SQL = f"""
marks AS (
  SELECT d.doc_id AS example_id, d.text, list_filter([CASE WHEN l.quality = 1 THEN 0 END, CASE WHEN l.toxic = 1 THEN 1 END,
    {sql.case('d.lang', corpus.CLASS_OF_LANG)} + 2]::INT[], lambda x: x IS NOT NULL) AS labels
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query("p1_rename_labels", f"WITH {MARKS_SQL} SELECT example_id, text, labels AS targets FROM marks")
def rename_labels(spark, sf_dir):
    return filters.rename_labels(corpus.multi_labelled(spark, sf_dir))


@query("p2_drop_inputs", f"WITH {MARKS_SQL} SELECT example_id, len(labels)::INT AS n_targets FROM marks")
def drop_inputs(spark, sf_dir):
    rows = filters.rename_labels(corpus.multi_labelled(spark, sf_dir))
    return filters.drop_inputs(rows.withColumn("n_targets", F.size("targets")), "multi_label")


@query(
    "p3_batched_map",
    f"""WITH {sql.SUMMARIES} SELECT example_id, length(summary)::BIGINT AS n_chars, upper(title) AS title
    FROM summaries WHERE text <> ''""",
)
def batched_map(spark, sf_dir):
    """A pandas function that emits fewer rows than it reads."""

    def keep_complete(batch):
        batch = batch[batch["text"] != ""]
        return batch.assign(n_chars=batch["summary"].str.len(), title=batch["title"].str.upper())[
            ["example_id", "n_chars", "title"]
        ]

    rows = corpus.summaries(spark, sf_dir)
    return filters.batched_map(rows, keep_complete, "example_id bigint, n_chars bigint, title string")


@query(
    "p4_tag_eval_mode",
    "SELECT vec_id AS example_id, embedding AS logits, label, 'clm' AS eval_mode FROM embeddings",
)
def tag_eval_mode(spark, sf_dir):
    return filters.tag_eval_mode(corpus.class_preds(spark, sf_dir), "clm")


@query(
    "p5_select_text_column",
    f"WITH {sql.SUMMARIES}, {sql.CHOICES} SELECT example_id, endings AS content FROM examples",
)
def select_text_column(spark, sf_dir):
    rows = corpus.choice_examples(spark, sf_dir)
    return filters.select_text_column(rows, "case_hold", "content").select("example_id", "content")


@query(
    "f1_drop_incomplete_pairs",
    f"WITH {sql.SUMMARIES} SELECT * FROM summaries WHERE text IS NOT NULL AND text <> '' AND summary IS NOT NULL AND summary <> ''",
)
def drop_incomplete_pairs(spark, sf_dir):
    return filters.drop_incomplete_pairs(corpus.summaries(spark, sf_dir))


@query(
    "f2_drop_overlong",
    f"""WITH {sql.SUMMARIES} SELECT example_id, {sql.words('text')} AS doc_ids, {sql.words('summary')} AS sum_ids
    FROM summaries WHERE len({sql.words('text')}) + len({sql.words('summary')}) <= 512""",
)
def drop_overlong(spark, sf_dir):
    rows = corpus.summaries(spark, sf_dir).select(
        "example_id", words(F.col("text")).alias("doc_ids"), words(F.col("summary")).alias("sum_ids")
    )
    return filters.drop_overlong(rows, 512)


@query("f3_char_band", "SELECT doc_id, text, n_chars FROM documents WHERE length(text) BETWEEN 5000 AND 20000")
def char_band(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return filters.char_band(docs)


ALLOWED = [t for t, kind in catalog.TASK_TYPES.items() if kind != "summarization"]


@query(
    "f4_validate_task",
    f"""WITH {sql.ADDRESSED} SELECT task, count(*) AS n_rows FROM addressed
    WHERE task NOT IN ({', '.join(f"'{t}'" for t in ALLOWED)}) GROUP BY task""",
)
def validate_task(spark, sf_dir):
    """Rows per task that the classification path rejects."""
    rows = corpus.addressed(corpus.table(spark, sf_dir, "documents"))
    allowed = catalog.allowed_tasks(catalog.task_catalog(spark))
    return filters.unknown_tasks(rows, allowed).groupBy("task").agg(F.count("*").alias("n_rows"))


@query(
    "f5_length_alignment",
    " UNION ALL ".join(
        f"""SELECT {k}::INT AS multiple, len({sql.words('text')}) % {k} = 0 AS aligned, count(*) AS n_rows
        FROM documents GROUP BY 2"""
        for k in (8, 128)
    ),
)
def length_alignment(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir).select(words(F.col("text")).alias("input_ids"))
    return filters.alignment_report(rows, 8, 128)


@query(
    "x1_allowed_tasks",
    f"""WITH {sql.ADDRESSED} SELECT task, count(*) AS n_rows FROM addressed
    WHERE task IN ({', '.join(f"'{t}'" for t in ALLOWED)}) GROUP BY task""",
)
def allowed_tasks(spark, sf_dir):
    rows = corpus.addressed(corpus.table(spark, sf_dir, "documents")).groupBy("task").agg(F.count("*").alias("n_rows"))
    return rows.join(F.broadcast(catalog.allowed_tasks(catalog.task_catalog(spark))), "task")


MULTI_HOT_SQL = "list_transform(range({n}), lambda i: CASE WHEN list_contains({t}, i::INT) THEN 1.0 ELSE 0.0 END::FLOAT)"


@query(
    "l1_multi_hot",
    f"WITH {MARKS_SQL} SELECT example_id, {MULTI_HOT_SQL.format(n=8, t='labels')} AS labels FROM marks",
)
def multi_hot_labels(spark, sf_dir):
    rows = corpus.multi_labelled(spark, sf_dir)
    return rows.select("example_id", multi_hot(F.col("labels"), 8).alias("labels"))


@query(
    "l2_label_names",
    f"""WITH {LABELS_SQL} SELECT vec_id AS example_id, label, label_name FROM embeddings
    LEFT JOIN (SELECT label_id AS label, label_name FROM label_catalog WHERE task = 'ecthr_a') USING (label)""",
)
def label_names(spark, sf_dir):
    rows = corpus.class_preds(spark, sf_dir).select("example_id", "label")
    return labels.label_names(rows, "ecthr_a")


@query(
    "l2_label_list_names",
    f"""WITH {MARKS_SQL}, {LABELS_SQL},
    names AS (SELECT list(label_name ORDER BY label_id) AS all_names FROM label_catalog WHERE task = 'unfair_tos')
    SELECT example_id, list_transform(labels, lambda i: all_names[i + 1]) AS label_names FROM marks, names""",
)
def label_list_names(spark, sf_dir):
    rows = corpus.multi_labelled(spark, sf_dir).select("example_id", "labels")
    return labels.label_list_names(rows, "unfair_tos", "labels").drop("labels")


@query(
    "l3_label_ids",
    f"""WITH {LABELS_SQL} SELECT vec_id AS example_id, label::VARCHAR AS label_name, label_id FROM embeddings
    LEFT JOIN (SELECT label_id, label_name FROM label_catalog WHERE task = 'ecthr_b') c ON label::VARCHAR = label_name""",
)
def label_ids(spark, sf_dir):
    """Article numbers as names; the numbers 0, 1, 4 and 7 are in no article list."""
    rows = corpus.class_preds(spark, sf_dir).select("example_id", F.col("label").cast("string").alias("label_name"))
    return labels.label_ids(rows, "ecthr_b")


@query(
    "l4_num_labels",
    f"""WITH {sql.ADDRESSED}, {LABELS_SQL}
    SELECT task, num_labels, n_rows FROM (SELECT task, count(*) AS num_labels FROM label_catalog GROUP BY 1)
    JOIN (SELECT task, count(*) AS n_rows FROM addressed GROUP BY 1) USING (task)""",
)
def num_labels(spark, sf_dir):
    counts = labels.num_labels(catalog.label_catalog(spark))
    rows = corpus.addressed(corpus.table(spark, sf_dir, "documents")).groupBy("task").agg(F.count("*").alias("n_rows"))
    return rows.join(F.broadcast(counts), "task").select("task", "num_labels", "n_rows")


@query(
    "b5_device_batch_size",
    """SELECT source, count(*) // 8 AS train, coalesce(nullif(count(l.doc_id), 0), count(*)) // 8 AS eval
    FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source""",
)
def device_batch_size(spark, sf_dir):
    """Rows per source as the global train size, its labelled rows as the global eval size."""
    marked = corpus.table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("marked"))
    sizes = (
        corpus.table(spark, sf_dir, "documents")
        .join(marked, "doc_id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("train"), F.count("marked").alias("eval"))
    )
    per_device = sampling.device_batch_size(F.col("train"), F.nullif("eval", F.lit(0)), F.lit(8))
    return sizes.select("source", per_device["train"].alias("train"), per_device["eval"].alias("eval"))


@query(
    "k15_ensure_pad_token",
    f"""WITH {sql.ADDRESSED}, config AS (
      SELECT tokenizer, CASE WHEN tokenizer LIKE '%t5%' THEN 0 END::INT AS pad_id, max(length(text))::INT AS eos_id
      FROM addressed GROUP BY 1)
    SELECT tokenizer, coalesce(pad_id, eos_id) AS pad_id, eos_id FROM config""",
)
def ensure_pad_token(spark, sf_dir):
    """One config row per tokenizer in use; its longest text stands in for the last id."""
    config = (
        corpus.addressed(corpus.table(spark, sf_dir, "documents"))
        .groupBy("tokenizer")
        .agg(F.max(F.length("text")).alias("eos_id"))
        .withColumn("pad_id", F.when(F.col("tokenizer").contains("t5"), F.lit(0)))
    )
    return encoding.ensure_pad_token(config)
