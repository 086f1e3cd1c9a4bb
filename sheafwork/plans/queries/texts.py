"""Prompts, normalisation and sentence splitting over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions import text as tx
from sheafwork.operators import sentences
from sheafwork.plans import corpus, sql
from sheafwork.plans.registry import query

STYLE_SQL = """CASE WHEN contains(tokenizer, 'mt5') THEN 'mt5'
  WHEN contains(tokenizer, 't5') OR contains(tokenizer, 'ul2') OR contains(tokenizer, 't0') OR contains(tokenizer, 'bart')
  THEN 't5' ELSE 'gpt' END"""
STYLED = f"""
styled AS (
  SELECT *, CASE style WHEN 't5' THEN 'summarize: ' ELSE '' END AS prefix,
    CASE style WHEN 't5' THEN chr(10) WHEN 'gpt' THEN ' TL;DR ' ELSE '' END AS suffix
  FROM (SELECT *, {STYLE_SQL} AS style FROM addressed))"""


def styled(spark, sf_dir):
    rows = corpus.addressed(corpus.documents(spark, sf_dir))
    return rows.withColumn("style", tx.prompt_style(F.col("tokenizer"))).select("*", "style.prefix", "style.suffix")


@query("t1_prompt_style", f"WITH {sql.ADDRESSED}, {STYLED} SELECT example_id, tokenizer, style, prefix, suffix FROM styled")
def prompt_style(spark, sf_dir):
    rows = styled(spark, sf_dir)
    return rows.select("example_id", "tokenizer", F.col("style.style").alias("style"), "prefix", "suffix")


@query("t2_wrap_prompt", f"WITH {sql.ADDRESSED}, {STYLED} SELECT example_id, prefix || text || suffix AS prompt FROM styled")
def wrap_prompt(spark, sf_dir):
    prompt = tx.wrap_prompt(F.col("text"), F.col("prefix"), F.col("suffix"))
    return styled(spark, sf_dir).select("example_id", prompt.alias("prompt"))


@query(
    "t3_titled_prompt",
    f"""WITH {sql.SUMMARIES} SELECT example_id, 'summarize: ' || ' ' || coalesce(title, '') || ' ' || text AS prompt
    FROM summaries""",
)
def titled_prompt(spark, sf_dir):
    prompt = tx.titled_prompt(F.col("title"), F.col("text"), F.lit(tx.T5_PREFIX))
    return corpus.summaries(spark, sf_dir).select("example_id", prompt.alias("prompt"))


CHOICE_PROMPT_SQL = """'Context: ' || context || chr(10) || chr(10) || 'Which of the following follow from the context?' || chr(10)
  || array_to_string(list_transform(endings, lambda e, i: (i - 1)::VARCHAR || ': ' || e || chr(10)), '')"""


@query(
    "t4_choice_prompt",
    f"WITH {sql.SUMMARIES}, {sql.CHOICES} SELECT example_id, {CHOICE_PROMPT_SQL} AS prompt FROM examples",
)
def choice_prompt(spark, sf_dir):
    prompt = tx.choice_prompt(F.col("context"), F.col("endings"))
    return corpus.choice_examples(spark, sf_dir).select("example_id", prompt.alias("prompt"))


@query("t5_normalize_for_rouge", f"SELECT doc_id AS example_id, {sql.rouge_tokens('text')} AS tokens FROM documents")
def normalize_for_rouge(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"), tx.rouge_tokens(F.col("text")).alias("tokens")
    )


@query(
    "t5_custom_normalizer",
    """SELECT doc_id AS example_id, list_filter(string_split(lower(text), 'e'), lambda w: w <> '') AS tokens FROM documents""",
)
def custom_normalizer(spark, sf_dir):
    """Normalizer and tokenizer given as expressions."""
    tokens = tx.rouge_tokens(F.col("text"), normalizer=F.lower, tokenizer=lambda c: F.split(c, "e"))
    return corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("example_id"), tokens.alias("tokens"))


def clean_sql(text: str) -> str:
    out = f"regexp_replace({text}, ' ([.?!,])', '\\1', 'g')"
    out = f"replace({out}, ' '' ', '''')"
    out = f"regexp_replace({out}, ' (n''t|''m|''s|''ve|''re)', '\\1', 'g')"
    return f"trim({out}, ' ' || chr(9) || chr(13) || chr(10) || chr(12))"


SPACED_SQL = "' ' || regexp_replace(text, '([.?!,])', ' \\1 ', 'g') || ' it ''s done , is n''t it ? '"


@query("t6_clean_decoded", f"SELECT doc_id AS example_id, {clean_sql(SPACED_SQL)} AS text FROM documents")
def clean_decoded(spark, sf_dir):
    """Texts with spaced-out punctuation and two contractions at the end."""
    spaced = F.concat(
        F.lit(" "), F.regexp_replace("text", "([.?!,])", " $1 "), F.lit(" it 's done , is n't it ? ")
    )
    return corpus.documents(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"), tx.clean_decoded(spaced).alias("text")
    )


@query("t7_split_sentences", f"SELECT doc_id AS example_id, {sql.sentences('text')} AS sentences FROM documents")
def split_sentences(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"), tx.split_sentences(F.col("text")).alias("sentences")
    )


_TYPE = f"regexp_replace(lower(regexp_replace(w, '{sentences.EDGES}', '', 'g')), '\\.$', '')"
ABBREVIATIONS = f"""
seen AS (SELECT {_TYPE} AS word, ends_with(regexp_replace(w, '{sentences.EDGES}', '', 'g'), '.')::INT AS dotted
  FROM (SELECT unnest({sql.words('text')}) AS w FROM documents)),
periods AS (SELECT word, sum(dotted)::BIGINT AS n_with, sum(1 - dotted)::BIGINT AS n_without FROM seen WHERE word <> '' GROUP BY word),
share AS (SELECT sum(n_with) / sum(n_with + n_without)::DOUBLE AS p FROM periods),
weighed AS (SELECT word, n_with, n_without, len(replace(word, '.', '')) AS letters,
  2 * (n_with * (ln({sentences.PERIOD_AFTER_ABBREVIATION}) - ln(p)) + n_without * (ln(1 - {sentences.PERIOD_AFTER_ABBREVIATION}) - ln(1 - p))) AS ratio
  FROM periods, share WHERE regexp_matches(word, '{sentences.ABBREVIABLE}')),
scored AS (SELECT word, n_with, n_without, ratio * exp(-letters) * (len(word) - letters + 1) * power(letters::DOUBLE, -n_without) AS score FROM weighed),
abbreviations AS (SELECT * FROM scored WHERE score >= {sentences.LEAST_SCORE})"""


@query("t7_abbreviations", f"WITH {ABBREVIATIONS} SELECT word, n_with, n_without, round(score, 6) AS score FROM abbreviations")
def abbreviations(spark, sf_dir):
    found = sentences.abbreviations(corpus.documents(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


_MARKED = f"regexp_replace(regexp_replace(regexp_replace(text, '{sentences.END_OF_LINE}', '\\1' || chr(2), 'g'), '{sentences.END_IN_LINE}', '\\1' || chr(1), 'g'), '{sentences.NEW_LINE}', chr(2), 'g')"


@query(
    "t7_split_trained",
    f"""WITH {ABBREVIATIONS}, cut AS (SELECT doc_id, string_split({_MARKED}, chr(1)) AS parts FROM documents),
    chunks AS (SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS chunk FROM cut),
    last_words AS (SELECT *, CASE WHEN ends_with(chunk, '.') THEN regexp_extract(chunk, '{sentences.LAST_WORD}') ELSE '' END AS w FROM chunks),
    typed AS (SELECT doc_id, place, chunk, {_TYPE} AS word FROM last_words),
    whole AS (SELECT doc_id, string_agg(chunk || CASE WHEN a.word IS NULL THEN chr(2) ELSE ' ' END, '' ORDER BY place) AS text
      FROM typed LEFT JOIN abbreviations a USING (word) GROUP BY doc_id)
    SELECT doc_id AS example_id, list_filter(string_split(w.text, chr(2)),
      lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(10) || chr(12)) <> '') AS sentences
    FROM documents LEFT JOIN whole w USING (doc_id)""",
)
def split_trained(spark, sf_dir):
    """Learns from the documents which words end in a period of their own, then cuts the same documents."""
    docs = corpus.documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").alias("example_id"), "text")
    return sentences.split_trained(rows, sentences.abbreviations(docs), {"text": "sentences"}).drop("text")
