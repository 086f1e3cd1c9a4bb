"""Multiple choice: exploding, pair features, regrouping, choosing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions.text import words
from sheafwork.operators import choices, encoding
from sheafwork.operators.encoding import BOS, EOS, PAD, SEP
from sheafwork.plans import builders, corpus, sql
from sheafwork.plans.registry import query
from sheafwork.sources import features, tables

MAX_LEN = 256
EXPLODED = f"""{sql.SUMMARIES}, {sql.CHOICES}, exploded AS (
  SELECT example_id, context, label, (generate_subscripts(endings, 1) - 1)::INT AS choice, unnest(endings) AS ending FROM examples)"""
PAIRED = f"""{sql.VOCAB}, {EXPLODED},
contexts AS (SELECT example_id, {sql.words('context')} AS tokens FROM examples),
offers AS (SELECT example_id * 8 + choice AS row_id, {sql.words('ending')} AS tokens FROM exploded),
{sql.encoded('contexts', 'tokens', 'a_ids', 'enc_a')}, {sql.encoded('offers', 'tokens', 'b_ids', 'enc_b', 'row_id')},
sized AS (SELECT x.example_id, x.choice, x.label, a_ids, b_ids, len(a_ids) AS la, len(b_ids) AS lb,
  greatest(0, len(a_ids) + len(b_ids) - {MAX_LEN - 3}) AS o
  FROM exploded x JOIN enc_a USING (example_id) JOIN enc_b b ON b.row_id = x.example_id * 8 + x.choice),
cut AS (SELECT *, least(o, greatest(la - lb, 0)) AS ca, least(o, greatest(lb - la, 0)) AS cb FROM sized),
kept AS (SELECT example_id, choice, label, a_ids[1:la - ca - (o - ca - cb) // 2] AS a,
  b_ids[1:lb - cb - (o - ca - cb + 1) // 2] AS b FROM cut),
features AS (SELECT example_id, choice, label,
  list_concat([{BOS}], a, [{SEP}], b, [{EOS}], {sql.repeat(PAD, f'{MAX_LEN - 3} - len(a) - len(b)')}) AS input_ids,
  list_concat({sql.repeat(1, 'len(a) + len(b) + 3')}, {sql.repeat(0, f'{MAX_LEN - 3} - len(a) - len(b)')}) AS attention_mask,
  list_concat({sql.repeat(0, 'len(a) + 2')}, {sql.repeat(1, 'len(b) + 1')},
    {sql.repeat(0, f'{MAX_LEN - 3} - len(a) - len(b)')}) AS token_type_ids FROM kept)"""
REGROUPED = f"""WITH {PAIRED} SELECT example_id, list(input_ids ORDER BY choice) AS input_ids,
  list(attention_mask ORDER BY choice) AS attention_mask, list(token_type_ids ORDER BY choice) AS token_type_ids,
  any_value(label) AS label FROM features GROUP BY example_id"""


def encoded_choices(spark, sf_dir):
    """Contexts and endings are encoded once for each example; then ids are dealt to the choices."""
    tokens = corpus.choice_examples(spark, sf_dir).select(
        "example_id", "label", words(F.col("context")).alias("context"), F.transform("endings", lambda e: words(e)).alias("endings")
    )
    tokens = tokens.select("example_id", "label", "context", F.flatten("endings").alias("all"), F.transform("endings", lambda e: F.size(e)).alias("sizes"))
    encoded = encoding.encode(tokens, corpus.vocabulary(spark, sf_dir), {"context": "context_ids", "all": "all_ids"})
    each = encoded.select("example_id", "label", "context_ids", "all_ids", "sizes", F.posexplode("sizes").alias("choice", "size"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("choice")), F.lit(0), lambda total, n: total + n)
    each = each.withColumn("ending_ids", F.slice("all_ids", before + 1, F.col("size")))
    encoded = each.select("example_id", "choice", "label", "context_ids", "ending_ids")
    return choices.encode_choices(encoded, MAX_LEN)


@query("m1_explode_choices", f"WITH {EXPLODED} SELECT * FROM exploded")
def explode_choices(spark, sf_dir):
    return choices.explode_choices(corpus.choice_examples(spark, sf_dir))


@query("m2_encode_choices", f"WITH {PAIRED} SELECT * FROM features")
def encode_choices(spark, sf_dir):
    return encoded_choices(spark, sf_dir)


@query("m3_regroup_choices", REGROUPED)
def regroup_choices(spark, sf_dir):
    return choices.regroup_choices(encoded_choices(spark, sf_dir))


@query(
    "m4_choose",
    """WITH e AS (SELECT vec_id AS example_id, list_transform(embedding, lambda x: x::DOUBLE) AS s, label FROM embeddings)
    SELECT example_id, (list_position(s, list_max(s)) - 1)::INT AS pred, label,
      round(ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) + list_max(s) - s[label + 1], 6) AS loss FROM e""",
)
def choose(spark, sf_dir):
    """Every component of a vector scores one choice."""
    rows = corpus.class_preds(spark, sf_dir).select(
        "example_id", "label", F.posexplode("logits").alias("choice", "score")
    )
    return choices.choose(rows).withColumn("loss", F.round("loss", 6))


@query("m5_multiple_choice_table", REGROUPED)
def multiple_choice_table(spark, sf_dir):
    """The same features without exploding the choices."""
    rows = corpus.choice_examples(spark, sf_dir)
    return builders.build_multiple_choice_table(rows, corpus.vocabulary(spark, sf_dir), MAX_LEN)


@query("m5_multiple_choice_cached", REGROUPED)
def multiple_choice_cached(spark, sf_dir):
    """The same table through the feature cache: the first call writes it, the second reads what the first has written."""

    def build():
        return builders.build_multiple_choice_table(corpus.choice_examples(spark, sf_dir), corpus.vocabulary(spark, sf_dir), MAX_LEN)

    def cached(make):
        root = f"{tables.shared_dir(spark)}/features-{spark.sparkContext.applicationId}"
        where = {"root": root, "key": f"choices_{MAX_LEN}", "sources": [f"{sf_dir}/documents.parquet"], "arguments": {"max_len": MAX_LEN}}
        return features.materialize_features(make, **where, stale="rewrite", spark=spark)

    def refuse():
        raise AssertionError("the second call builds nothing")

    cached(build)
    return cached(refuse)
