"""Global positions, shards and batches over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.operators import sampling
from sheafwork.operators.metrics import eval_union
from sheafwork.operators.filters import tag_eval_mode
from sheafwork.plans import corpus, sql
from sheafwork.plans.registry import query

SEED, WORLD = 42, 7
ORDERED = """ordered AS (SELECT doc_id AS example_id, row_number() OVER (ORDER BY doc_id) - 1 AS position,
  (SELECT count(*) FROM documents) AS n_rows FROM documents)"""
SHUFFLED = f"""shuffled AS (SELECT doc_id AS example_id,
  row_number() OVER (ORDER BY md5('{SEED}:' || doc_id::VARCHAR)) - 1 AS position FROM documents)"""
SHARDED = f"""sharded AS (SELECT example_id, position, (position % {WORLD})::INT AS shard_id, position // {WORLD} AS local_position
  FROM shuffled)"""
BATCHED = f"{SHUFFLED}, {SHARDED}, batched AS (SELECT *, local_position // 16 AS batch_id FROM sharded)"


def ids(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"))


def batched(spark, sf_dir):
    sharded = sampling.assign_shard(sampling.shuffle(ids(spark, sf_dir), SEED), WORLD)
    return sampling.assign_batch(sharded, 16)


@query("b1_shuffle", f"WITH {SHUFFLED} SELECT * FROM shuffled")
def shuffle(spark, sf_dir):
    return sampling.shuffle(ids(spark, sf_dir), SEED)


@query("b2_assign_shard", f"WITH {SHUFFLED}, {SHARDED} SELECT * FROM sharded")
def assign_shard(spark, sf_dir):
    return sampling.assign_shard(sampling.shuffle(ids(spark, sf_dir), SEED), WORLD)


@query(
    "b3_even_shards_keep",
    f"""WITH {ORDERED} SELECT example_id, position, n_rows FROM ordered
    UNION ALL SELECT example_id, position + n_rows, n_rows FROM ordered
    WHERE position < ({WORLD} - n_rows % {WORLD}) % {WORLD}""",
)
def even_shards_keep(spark, sf_dir):
    return sampling.even_shards(sampling.position_by_id(ids(spark, sf_dir), total="n_rows"), WORLD, drop_last=False)


@query(
    "b3_even_shards_drop",
    f"WITH {ORDERED} SELECT example_id, position, n_rows FROM ordered WHERE position < n_rows - n_rows % {WORLD}",
)
def even_shards_drop(spark, sf_dir):
    return sampling.even_shards(sampling.position_by_id(ids(spark, sf_dir), total="n_rows"), WORLD, drop_last=True)


@query("b4_assign_batch", f"WITH {BATCHED} SELECT * FROM batched")
def assign_batch(spark, sf_dir):
    return batched(spark, sf_dir)


@query("b6_first_batches", f"WITH {BATCHED} SELECT * FROM batched WHERE batch_id < 3")
def first_batches(spark, sf_dir):
    """The limit on evaluated batches is the feature here."""
    return sampling.first_batches(batched(spark, sf_dir), 3)


@query(
    "b7_preview",
    """SELECT vec_id AS example_id, embedding AS logits, label, len(embedding)::INT AS logits_shape
    FROM embeddings ORDER BY vec_id LIMIT 2""",
)
def preview(spark, sf_dir):
    """The two rows that the log shows."""
    return sampling.preview(corpus.class_preds(spark, sf_dir), 2, arrays=("logits",))


@query("b8_lookup", "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id = 123")
def lookup(spark, sf_dir):
    return sampling.lookup(corpus.table(spark, sf_dir, "documents"), 123, "doc_id")


@query(
    "x2_eval_union",
    f"""WITH {SHUFFLED}, {ORDERED} SELECT example_id, position, 'clm' AS eval_mode FROM shuffled
    UNION ALL SELECT example_id, position, 'seq2seq' AS eval_mode FROM ordered""",
)
def union_of_evaluators(spark, sf_dir):
    shuffled = tag_eval_mode(sampling.shuffle(ids(spark, sf_dir), SEED), "clm")
    ordered = tag_eval_mode(sampling.position_by_id(ids(spark, sf_dir)), "seq2seq")
    return eval_union(shuffled, ordered)
