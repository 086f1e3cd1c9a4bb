"""Sequence assembly, block packing and the feature builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions import arrays
from sheafwork.functions.text import words
from sheafwork.operators import encoding, packing, sampling
from sheafwork.operators.encoding import BOS, EOS, PAD
from sheafwork.plans import builders, corpus, sql
from sheafwork.plans.queries.tables import MARKS_SQL, MULTI_HOT_SQL
from sheafwork.plans.queries.tokens import ENCODED, MASKED, PAIR_ENCODED, DOC_TOKENS, doc_ids, doc_tokens, padded, pair_ids, sized_ids
from sheafwork.plans.registry import query

SUFFIX = [7, 8, 9]


@query(
    "q1_append_suffix",
    f"""WITH {MASKED} SELECT example_id, list_concat(ids, {SUFFIX}) AS input_ids,
    list_concat(list_transform(ids, lambda x: (x <> {PAD})::INT), [1, 1, 1]) AS attention_mask FROM padded""",
)
def append_suffix(spark, sf_dir):
    width = F.col("width")
    return sized_ids(spark, sf_dir).select(
        "example_id",
        arrays.append_suffix(arrays.pad_to(F.col("ids"), width, PAD), arrays.ints(SUFFIX)).alias("input_ids"),
        arrays.extend_mask(arrays.attention_mask(F.size("ids"), width), F.lit(3)).alias("attention_mask"),
    )


@query(
    "q2_join_sequences",
    f"WITH {PAIR_ENCODED} SELECT example_id, list_concat(a_ids, b_ids) AS input_ids FROM pairs",
)
def join_sequences(spark, sf_dir):
    joined = arrays.join_sequences(F.col("a_ids"), F.col("b_ids"))
    return pair_ids(spark, sf_dir).select("example_id", joined.alias("input_ids"))


@query("q3_copy_labels", f"WITH {ENCODED} SELECT example_id, ids AS input_ids, ids AS labels FROM enc")
def copy_labels(spark, sf_dir):
    rows = doc_ids(spark, sf_dir).withColumnRenamed("ids", "input_ids")
    return rows.withColumn("labels", F.col("input_ids"))


@query(
    "q4_shift_targets",
    f"""WITH {ENCODED} SELECT example_id, CASE WHEN len(ids) > 0 THEN list_concat(ids[2:], [-100]) ELSE []::INT[] END AS targets
    FROM enc""",
)
def shift_targets(spark, sf_dir):
    return doc_ids(spark, sf_dir).select("example_id", arrays.shift_targets(F.col("ids")).alias("targets"))


@query(
    "q5_last_real_index",
    f"""WITH {MASKED} SELECT example_id, (len(list_filter(ids, lambda x: x <> {PAD})) - 1)::INT AS on_right,
    coalesce(list_max([i for i in range(len(ids)) if list_reverse(ids)[i + 1] <> {PAD}]), -1)::INT AS on_left FROM padded""",
)
def last_real_index(spark, sf_dir):
    rows = padded(spark, sf_dir)
    return rows.select(
        "example_id",
        arrays.last_real_index(F.col("ids"), PAD).alias("on_right"),
        arrays.last_real_index(F.reverse("ids"), PAD, "left").alias("on_left"),
    )


@query(
    "q6_pick_at",
    f"""WITH {MASKED} SELECT example_id, ids[len(list_filter(ids, lambda x: x <> {PAD}))] AS last_id FROM padded""",
)
def pick_at(spark, sf_dir):
    rows = padded(spark, sf_dir).withColumn("at", arrays.last_real_index(F.col("ids"), PAD))
    return rows.select("example_id", arrays.pick_at(F.col("ids"), F.col("at")).alias("last_id"))


def packed_sql(batch: str) -> str:
    return f"""WITH {ENCODED}, placed AS (
      SELECT *, {batch} AS batch_id FROM (SELECT *, row_number() OVER (ORDER BY example_id) - 1 AS position FROM enc)),
    flat AS (
      SELECT batch_id, (row_number() OVER (PARTITION BY batch_id ORDER BY example_id, pos) - 1) AS idx, id FROM (
        SELECT batch_id, example_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM placed)),
    blocks AS (SELECT batch_id, (idx // 256)::BIGINT AS block_id, list(id ORDER BY idx) AS input_ids FROM flat GROUP BY 1, 2)
    SELECT {{}} block_id, input_ids, input_ids AS labels FROM blocks WHERE len(input_ids) = 256 OR block_id = 0"""


@query("q7_pack_blocks", packed_sql("(position // 100)::BIGINT").format("batch_id,"))
def pack_blocks(spark, sf_dir):
    """Blocks of 256 ids within map batches of 100 rows, which are placed before encoding."""
    placed = sampling.assign_batch(sampling.position_by_id(doc_tokens(spark, sf_dir)), 100, "position")
    encoded = encoding.encode(placed, corpus.vocabulary(spark, sf_dir), {"tokens": "input_ids"})
    return packing.pack_blocks(encoded, 256)


@query("q7_pack_blocks_global", packed_sql("0").format(""))
def pack_blocks_global(spark, sf_dir):
    tokens = doc_tokens(spark, sf_dir).withColumn("n", F.size("tokens"))
    encoded = encoding.encode(tokens, corpus.vocabulary(spark, sf_dir), {"tokens": "input_ids"})
    return packing.pack_blocks_global(encoded, 256, length=F.col("n"))


MAX_INPUT, MAX_TARGET = 7296, 768
ROOM = MAX_INPUT - 1  # the suffix " TL;DR " is one word
CLM_SQL = f"""{sql.VOCAB}, {sql.SUMMARIES}, clm_toks AS (
  SELECT example_id, ({sql.words("' ' || coalesce(title, '') || ' ' || text")})[1:{ROOM}] AS a,
    ({sql.words('summary')})[1:{MAX_TARGET}] AS b FROM summaries WHERE text <> '' AND summary <> ''),
{sql.encoded('clm_toks', 'a', 'a_ids', 'enc_a')}, {sql.encoded('clm_toks', 'b', 'b_ids', 'enc_b')},
suffix AS (SELECT coalesce((SELECT id FROM vocab WHERE token = 'TL;DR'), 1)::INT AS suffix_id),
joined AS (SELECT example_id,
  list_concat({sql.repeat(PAD, f'{ROOM} - len(a_ids)')}, a_ids, [suffix_id], b_ids, {sql.repeat(PAD, f'{MAX_TARGET} - len(b_ids)')}) AS input_ids,
  list_concat({sql.repeat(0, f'{ROOM} - len(a_ids)')}, {sql.repeat(1, 'len(a_ids) + 1 + len(b_ids)')},
    {sql.repeat(0, f'{MAX_TARGET} - len(b_ids)')}) AS attention_mask
  FROM enc_a JOIN enc_b USING (example_id), suffix)"""


@query("q8_build_clm_table", f"WITH {CLM_SQL} SELECT *, input_ids AS labels FROM joined")
def build_clm_table(spark, sf_dir):
    rows = corpus.summaries(spark, sf_dir)
    return builders.build_clm_table(rows, corpus.vocabulary(spark, sf_dir), MAX_INPUT, MAX_TARGET)


@query(
    "q8_build_clm_table_masked",
    f"""WITH {CLM_SQL} SELECT *, list_concat({sql.repeat(-100, str(MAX_INPUT))},
      list_transform(range({MAX_INPUT + 1}, {MAX_INPUT + MAX_TARGET + 1}),
        lambda i: CASE WHEN attention_mask[i] = 0 THEN -100 ELSE input_ids[i] END::INT)) AS labels FROM joined""",
)
def build_clm_table_masked(spark, sf_dir):
    """Pads and prompt ignored in the labels."""
    rows = corpus.summaries(spark, sf_dir)
    vocab = corpus.vocabulary(spark, sf_dir)
    return builders.build_clm_table(rows, vocab, MAX_INPUT, MAX_TARGET, mask_pad=True, mask_prompt=True)


SEQ2SEQ_SQL = f"""{sql.VOCAB}, {sql.SUMMARIES}, s2s_toks AS (
  SELECT example_id, {sql.words("'summarize: ' || text || chr(10)")} AS a, {sql.words('summary')} AS b
  FROM summaries WHERE text <> '' AND summary <> ''),
{sql.encoded('s2s_toks', 'a', 'input_ids', 'enc_a')}, {sql.encoded('s2s_toks', 'b', 'labels', 'enc_b')}"""


@query(
    "q9_build_seq2seq_table",
    f"""WITH {SEQ2SEQ_SQL} SELECT example_id, input_ids, {sql.repeat(1, 'len(input_ids)')} AS attention_mask,
    list_transform(labels, lambda x: CASE WHEN x = {PAD} THEN -100 ELSE x END::INT) AS labels
    FROM enc_a JOIN enc_b USING (example_id)""",
)
def build_seq2seq_table(spark, sf_dir):
    rows = corpus.summaries(spark, sf_dir)
    return builders.build_seq2seq_table(rows, corpus.vocabulary(spark, sf_dir), "summarize: ", "\n")


def class_sql(tokens: str, label: str, max_len: int) -> str:
    room = max_len - 2
    return f"""cut AS (SELECT example_id, tokens[1:{room}] AS tokens FROM {tokens}), {sql.encoded('cut', 'tokens', 'ids', 'enc')}
    SELECT example_id, list_concat([{BOS}], ids, [{EOS}], {sql.repeat(PAD, f'{room} - len(ids)')}) AS input_ids,
      list_concat({sql.repeat(1, 'len(ids) + 2')}, {sql.repeat(0, f'{room} - len(ids)')}) AS attention_mask, {label}"""


@query(
    "q10_classification_multi_class",
    f"""WITH {sql.VOCAB}, {DOC_TOKENS}, {class_sql('toks', sql.case('lang', corpus.CLASS_OF_LANG) + '::INT AS label', 256)}
    FROM enc JOIN documents d ON d.doc_id = example_id""",
)
def classification_multi_class(spark, sf_dir):
    rows = corpus.classified(spark, sf_dir)
    return builders.build_classification_table(rows, corpus.vocabulary(spark, sf_dir), "ledgar", 256)


@query(
    "q10_classification_multi_label",
    f"""WITH {sql.VOCAB}, {DOC_TOKENS}, {MARKS_SQL},
    {class_sql('toks', MULTI_HOT_SQL.format(n=8, t='m.labels') + ' AS labels', 128)} FROM enc JOIN marks m USING (example_id)""",
)
def classification_multi_label(spark, sf_dir):
    rows = corpus.multi_labelled(spark, sf_dir)
    return builders.build_classification_table(rows, corpus.vocabulary(spark, sf_dir), "unfair_tos", 128)


@query("q11_sequence_length", f"WITH {DOC_TOKENS} SELECT example_id, len(tokens)::INT AS n FROM toks")
def sequence_length(spark, sf_dir):
    return doc_tokens(spark, sf_dir).select("example_id", arrays.sequence_length(F.col("tokens")).alias("n"))
