"""Vocabulary, encoding, truncation, padding, masks and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions import arrays
from sheafwork.functions.text import words
from sheafwork.operators import encoding, sampling
from sheafwork.operators.encoding import BOS, EOS, PAD, SEP
from sheafwork.plans import corpus, sql
from sheafwork.plans.registry import query
from sheafwork.sources.tables import stored

DOC_TOKENS = f"toks AS (SELECT doc_id AS example_id, {sql.words('text')} AS tokens FROM documents)"
ENCODED = f"{sql.VOCAB}, {DOC_TOKENS}, {sql.encoded('toks', 'tokens', 'ids', 'enc')}"
PAIR_TOKENS = f"""{sql.SUMMARIES}, pair_toks AS (
  SELECT example_id, {sql.words('text')} AS a, {sql.words('summary')} AS b FROM summaries)"""
PAIR_ENCODED = f"""{sql.VOCAB}, {PAIR_TOKENS}, {sql.encoded('pair_toks', 'a', 'a_ids', 'enc_a')},
{sql.encoded('pair_toks', 'b', 'b_ids', 'enc_b')}, pairs AS (SELECT * FROM enc_a JOIN enc_b USING (example_id))"""


def doc_tokens(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("example_id"), words(F.col("text")).alias("tokens"))


def doc_ids(spark, sf_dir):
    rows = doc_tokens(spark, sf_dir)
    encoded = encoding.encode(rows, corpus.vocabulary(spark, sf_dir), {"tokens": "ids"})
    return encoded.select("example_id", "ids")


def pair_ids(spark, sf_dir):
    rows = corpus.summaries(spark, sf_dir).select(
        "example_id", words(F.col("text")).alias("a"), words(F.col("summary")).alias("b")
    )
    encoded = encoding.encode(rows, corpus.vocabulary(spark, sf_dir), {"a": "a_ids", "b": "b_ids"})
    return encoded.select("example_id", "a_ids", "b_ids")


#: Rows of a batch, in the order of their ids; a batch is padded to its own longest row.
BATCH = 16


def sized_sql(source: str, length: str) -> str:
    """CTE ``sized``: the rows of ``source`` with their batch and its longest row."""
    return f"""placed AS (SELECT *, (row_number() OVER (ORDER BY example_id) - 1) // {BATCH} AS batch_id FROM {source}),
    sized AS (SELECT *, (max({length}) OVER (PARTITION BY batch_id))::INT AS width FROM placed)"""


def sized(rows: DataFrame, length: Column) -> DataFrame:
    placed = sampling.assign_batch(sampling.position_by_id(rows), BATCH, "position").drop("position")
    return placed.withColumn("width", F.max(length).over(Window.partitionBy("batch_id")).cast("int"))


def sized_ids(spark, sf_dir):
    return sized(doc_ids(spark, sf_dir), F.size("ids"))


BATCHED = f"{ENCODED}, {sized_sql('enc', 'len(ids)')}"


@query("k1_tokenize", f"WITH {DOC_TOKENS} SELECT * FROM toks")
def tokenize(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("example_id"), "text")
    return encoding.tokenize(rows).drop("text")


@query("k2_build_vocab", f"WITH {sql.VOCAB} SELECT * FROM vocab WHERE id < {corpus.VOCAB_SIZE}")
def build_vocab(spark, sf_dir):
    return encoding.build_vocab(corpus.documents(spark, sf_dir), ["text"], corpus.VOCAB_SIZE)


@query("k3_encode", f"WITH {ENCODED} SELECT * FROM enc")
def encode(spark, sf_dir):
    return doc_ids(spark, sf_dir)


@query("k3_encode_by_join", f"WITH {ENCODED} SELECT * FROM enc")
def encode_by_join(spark, sf_dir):
    """With an empty head: every token comes from the join."""
    rows = doc_tokens(spark, sf_dir)
    encoded = encoding.encode(rows, corpus.vocabulary(spark, sf_dir), {"tokens": "ids"}, head_rows=0)
    return encoded.select("example_id", "ids")


@query("k4_vocab_size", f"WITH {sql.VOCAB} SELECT count(*) AS vocab_size FROM vocab WHERE id < {corpus.VOCAB_SIZE}")
def vocab_size(spark, sf_dir):
    return encoding.vocab_size(build_vocab(spark, sf_dir))


@query(
    "k5_add_special_tokens",
    f"""WITH {PAIR_ENCODED} SELECT example_id, list_concat([{BOS}], b_ids, [{EOS}]) AS single,
    list_concat([{BOS}], a_ids, [{SEP}], b_ids, [{EOS}]) AS pair,
    list_concat([{BOS}], a_ids, [{SEP}, {SEP}], b_ids, [{EOS}]) AS wide_pair FROM pairs""",
)
def add_special_tokens(spark, sf_dir):
    a, b = F.col("a_ids"), F.col("b_ids")
    return pair_ids(spark, sf_dir).select(
        "example_id",
        arrays.add_special_tokens(b, BOS, EOS).alias("single"),
        arrays.add_pair_special_tokens(a, b, BOS, SEP, EOS).alias("pair"),
        arrays.add_pair_special_tokens(a, b, BOS, SEP, EOS, seps=2).alias("wide_pair"),
    )


@query("k6_truncate", f"WITH {ENCODED} SELECT example_id, ids[1:254] AS ids FROM enc")
def truncate(spark, sf_dir):
    return doc_ids(spark, sf_dir).select("example_id", arrays.truncate(F.col("ids"), 256, specials=2).alias("ids"))


@query(
    "k7_truncate_pair",
    f"""WITH {PAIR_ENCODED}, sized AS (SELECT *, len(a_ids) AS la, len(b_ids) AS lb FROM pairs),
    over AS (SELECT *, greatest(0, la + lb - 253) AS o FROM sized),
    cut AS (SELECT *, least(o, greatest(la - lb, 0)) AS ca, least(o, greatest(lb - la, 0)) AS cb FROM over)
    SELECT example_id, a_ids[1:la - ca - (o - ca - cb) // 2] AS a, b_ids[1:lb - cb - (o - ca - cb + 1) // 2] AS b FROM cut""",
)
def truncate_pair(spark, sf_dir):
    cut = arrays.truncate_pair(F.col("a_ids"), F.col("b_ids"), 253)
    return pair_ids(spark, sf_dir).select("example_id", cut["a"].alias("a"), cut["b"].alias("b"))


@query(
    "k8_pad_to",
    f"""WITH {BATCHED} SELECT example_id, list_concat(ids, {sql.repeat(PAD, 'width - len(ids)')}) AS on_right,
    list_concat({sql.repeat(PAD, 'width - len(ids)')}, ids) AS on_left FROM sized""",
)
def pad_to(spark, sf_dir):
    """Whole documents, each to its batch's longest."""
    return sized_ids(spark, sf_dir).select(
        "example_id",
        arrays.pad_to(F.col("ids"), F.col("width"), PAD).alias("on_right"),
        arrays.pad_to(F.col("ids"), F.col("width"), PAD, "left").alias("on_left"),
    )


@query(
    "k9_pad_to_longest",
    f"""WITH {ENCODED},
    placed AS (SELECT *, (row_number() OVER (ORDER BY example_id) - 1) // 16 AS batch_id FROM enc),
    sized AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 128.0) * 128)::INT AS padded_length FROM placed)
    SELECT example_id, batch_id, padded_length, list_concat(ids, {sql.repeat(PAD, 'padded_length - len(ids)')}) AS input_ids,
    list_concat({sql.repeat(1, 'len(ids)')}, {sql.repeat(0, 'padded_length - len(ids)')}) AS attention_mask FROM sized""",
)
def pad_to_longest(spark, sf_dir):
    """Batches of 16 consecutive documents, padded to multiples of 128."""
    encoded = doc_ids(spark, sf_dir).withColumnRenamed("ids", "input_ids")
    placed = sampling.assign_batch(sampling.position_by_id(encoded), BATCH, "position").drop("position")
    return encoding.pad_to_longest(placed, PAD, multiple=128)


@query(
    "k10_attention_mask",
    f"""WITH {DOC_TOKENS}, t AS (SELECT example_id, len(tokens) AS n FROM toks), {sized_sql('t', 'n')}
    SELECT example_id, list_concat({sql.repeat(1, 'n')}, {sql.repeat(0, 'width - n')}) AS on_right,
    list_concat({sql.repeat(0, 'width - n')}, {sql.repeat(1, 'n')}) AS on_left FROM sized""",
)
def attention_mask(spark, sf_dir):
    rows = doc_tokens(spark, sf_dir).select("example_id", F.size("tokens").alias("n"))
    return sized(rows, F.col("n")).select(
        "example_id",
        arrays.attention_mask(F.col("n"), F.col("width")).alias("on_right"),
        arrays.attention_mask(F.col("n"), F.col("width"), "left").alias("on_left"),
    )


@query(
    "k11_token_type_ids",
    f"""WITH {PAIR_TOKENS}, t AS (SELECT example_id, len(a) + 2 AS na, len(b) + 1 AS nb FROM pair_toks), {sized_sql('t', 'na + nb')}
    SELECT example_id, list_concat({sql.repeat(0, 'na')}, {sql.repeat(1, 'nb')}, {sql.repeat(0, 'width - na - nb')}) AS token_type_ids
    FROM sized""",
)
def token_type_ids(spark, sf_dir):
    rows = corpus.summaries(spark, sf_dir).select(
        "example_id",
        (F.size(words(F.col("text"))) + 2).alias("na"),
        (F.size(words(F.col("summary"))) + 1).alias("nb"),
    )
    rows = sized(rows, F.col("na") + F.col("nb"))
    return rows.select("example_id", arrays.token_type_ids(F.col("na"), F.col("nb"), F.col("width")).alias("token_type_ids"))


MASKED = f"""{BATCHED}, padded AS (
  SELECT example_id, list_concat(ids, {sql.repeat(PAD, 'width - len(ids)')}) AS ids FROM sized)"""


def padded(spark, sf_dir):
    """Whole documents, padded to their batch's longest."""
    return sized_ids(spark, sf_dir).select("example_id", arrays.pad_to(F.col("ids"), F.col("width"), PAD).alias("ids"))


@query(
    "k12_mask_pad_labels",
    f"""WITH {MASKED} SELECT example_id,
    list_transform(ids, lambda x: CASE WHEN x = {PAD} THEN -100 ELSE x END::INT) AS labels FROM padded""",
)
def mask_pad_labels(spark, sf_dir):
    return padded(spark, sf_dir).select("example_id", arrays.mask_pad_labels(F.col("ids"), PAD).alias("labels"))


@query("k13_unmask_labels", f"WITH {MASKED} SELECT example_id, ids AS labels FROM padded")
def unmask_labels(spark, sf_dir):
    """Masking and unmasking gives the padded ids back."""
    masked = padded(spark, sf_dir).select("example_id", arrays.mask_pad_labels(F.col("ids"), PAD).alias("labels"))
    return masked.select("example_id", arrays.unmask_labels(F.col("labels"), PAD).alias("labels"))


DECODED_SQL = "regexp_replace(array_to_string(known, ' '), ' ([.?!,])', '\\1', 'g')"


@query(
    "k14_decode",
    f"""WITH {sql.VOCAB}, {DOC_TOKENS}, kept AS (
      SELECT s.example_id, coalesce(e.known, []::VARCHAR[]) AS known FROM toks s LEFT JOIN (
        SELECT example_id, list(token ORDER BY pos) AS known
        FROM (SELECT example_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM toks)
        SEMI JOIN (SELECT token FROM vocab WHERE id >= 5) v USING (token) GROUP BY 1) e USING (example_id))
    SELECT example_id, trim(regexp_replace(replace({DECODED_SQL}, ' '' ', ''''), ' (n''t|''m|''s|''ve|''re)', '\\1', 'g'),
      ' ' || chr(9) || chr(13) || chr(10) || chr(12)) AS text FROM kept""",
)
def decode(spark, sf_dir):
    """Encode, then decode: unknown tokens are gone, spacing is tidied."""
    table = corpus.vocabulary(spark, sf_dir)
    vocab = encoding.load_codec(table)
    encoded = encoding.encode(doc_tokens(spark, sf_dir), vocab, {"tokens": "ids"}).select("example_id", "ids")
    return encoding.decode(stored(encoded), vocab, {"ids": "text"}).select("example_id", "text")
