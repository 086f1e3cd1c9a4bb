"""ROUGE over whole document bodies and conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions import stemming
from sheafwork.functions.text import rouge_tokens
from sheafwork.operators import encoding, rouge
from sheafwork.plans import corpus, evaluation, sql
from sheafwork.plans.registry import query
from sheafwork.sources.tables import stored

PAIRS = f"""{sql.SUMMARIES}, pairs AS (
  SELECT example_id, 0 AS ref_id, {sql.rouge_tokens('text')} AS p, {sql.rouge_tokens('summary')} AS r FROM summaries)"""
REF_PAIRS = f"""pairs AS (
  SELECT a.conv_id AS example_id, a.turn AS ref_id, {sql.rouge_tokens('o.text')} AS p, {sql.rouge_tokens('a.text')} AS r
  FROM conversations a JOIN conversations o ON o.conv_id = a.conv_id AND o.turn = 0 WHERE a.role = 'assistant')"""


def overlap_sql(n: int) -> str:
    """CTE ``hits{n}``: clipped n-gram hits and n-gram counts of both sides per pair."""

    def grams(side: str) -> str:
        if n == 1:
            return side
        parts = " || ' ' || ".join(f"{side}[i + {k}]" for k in range(n))
        return f"list_transform(range(1, len({side}) - {n - 2}), lambda i: {parts})"

    return f"""
grams{n} AS (SELECT example_id, ref_id, gram, sum(p) AS p, sum(r) AS r FROM (
  SELECT example_id, ref_id, unnest({grams('p')}) AS gram, 1 AS p, 0 AS r FROM pairs
  UNION ALL SELECT example_id, ref_id, unnest({grams('r')}), 0, 1 FROM pairs) GROUP BY 1, 2, 3),
hits{n} AS (SELECT example_id, ref_id, coalesce(h, 0) AS h, coalesce(np, 0) AS np, coalesce(nr, 0) AS nr
  FROM pairs LEFT JOIN (SELECT example_id, ref_id, sum(least(p, r)) AS h, sum(p) AS np, sum(r) AS nr FROM grams{n} GROUP BY 1, 2)
  USING (example_id, ref_id))"""


def scored_sql(key: str) -> str:
    found = "h > 0 AND np > 0 AND nr > 0"
    return f"""CASE WHEN {found} THEN 2 * h / (np + nr)::DOUBLE ELSE 0 END::DOUBLE AS {key}_fmeasure,
    CASE WHEN {found} THEN h / np::DOUBLE ELSE 0 END::DOUBLE AS {key}_precision,
    CASE WHEN {found} THEN h / nr::DOUBLE ELSE 0 END::DOUBLE AS {key}_recall"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith("rouge")})


def rounded_sql(keys) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in rouge.score_columns(keys))


def rouge_n_sql(n: int) -> str:
    return f"""WITH {PAIRS}, {overlap_sql(n)}, scored AS (SELECT example_id, {scored_sql(f'rouge{n}')} FROM hits{n})
    SELECT example_id, {rounded_sql([f'rouge{n}'])} FROM scored"""


@query("e12_rouge_1", rouge_n_sql(1))
def rouge_1(spark, sf_dir):
    return rounded(rouge.rouge_n(corpus.text_pairs(spark, sf_dir), 1))


@query("e12_rouge_2", rouge_n_sql(2))
def rouge_2(spark, sf_dir):
    return rounded(rouge.rouge_n(corpus.text_pairs(spark, sf_dir), 2))


# The recursive table carries one row of the usual table per pair: step i reads token i of
# the shorter side against the whole longer side. Tokens that only one side has are left out
# beforehand, since no common subsequence can use them.
LCS_TABLES = f"""
shared AS (SELECT example_id, len(p) AS np, len(r) AS nr, list_filter(p, lambda w: list_contains(r, w)) AS p,
  list_filter(r, lambda w: list_contains(p, w)) AS r FROM pairs),
sides AS (SELECT example_id, np, nr, CASE WHEN len(p) <= len(r) THEN p ELSE r END AS a,
  CASE WHEN len(p) <= len(r) THEN r ELSE p END AS b FROM shared),
steps AS (
  SELECT example_id, 0 AS i, list_resize([]::INT[], len(b) + 1, 0) AS line, a, b FROM sides
  UNION ALL
  SELECT example_id, i + 1, list_reduce(list_transform(range(1, len(b) + 1),
      lambda j: [CASE WHEN b[j] = a[i + 1] THEN line[j] + 1 ELSE line[j + 1] END]),
      lambda acc, x: list_concat(acc, [greatest(acc[-1], x[1])]), [0]), a, b
  FROM steps WHERE i < len(a)),
lcs AS (SELECT example_id, line[-1] AS h, np, nr FROM steps JOIN sides USING (example_id) WHERE i = len(sides.a))"""
LCS_SQL = f"""WITH RECURSIVE {PAIRS}, {LCS_TABLES}, scored AS (SELECT example_id, {scored_sql('rougeL')} FROM lcs)
SELECT example_id, {rounded_sql(['rougeL'])} FROM scored"""

# Every predicted sentence that shares a word with a reference sentence walks through it token by
# token. A cell holds the length of the subsequence and the reference positions that the walk back
# from it would pass: over the diagonal if the tokens are equal, else up if that is longer, else left.
_SENTENCES = "list_transform({0}, lambda s: {1})"
LSUM_TABLES = f"""
cut AS (SELECT example_id, {_SENTENCES.format(sql.sentences('text'), sql.rouge_tokens('s'))} AS ps,
  {_SENTENCES.format(sql.sentences('summary'), sql.rouge_tokens('s'))} AS rs FROM summaries),
refs AS (SELECT example_id, generate_subscripts(rs, 1) AS k, unnest(rs) AS r FROM cut),
preds AS (SELECT DISTINCT example_id, unnest(ps) AS p FROM cut),
walks AS (
  SELECT example_id, k, r, p, 0 AS i, list_transform(range(0, len(r) + 1), lambda j: {{'n': 0, 'at': []::BIGINT[], 'd': false}}) AS line
  FROM refs JOIN preds USING (example_id) WHERE list_has_any(p, r)
  UNION ALL
  SELECT example_id, k, r, p, i + 1, list_reduce(list_transform(range(1, len(r) + 1),
      lambda j: [{{'n': line[j].n + 1, 'at': list_append(line[j].at, j), 'd': r[j] = p[i + 1]}}, line[j + 1]]),
      lambda acc, x: list_concat(acc, [CASE WHEN x[1].d THEN x[1] WHEN x[2].n > acc[-1].n THEN x[2] ELSE acc[-1] END]),
      [{{'n': 0, 'at': []::BIGINT[], 'd': false}}])
  FROM walks WHERE i < len(p)),
passed AS (SELECT DISTINCT example_id, k, r, unnest(line[-1].at) AS j FROM walks WHERE i = len(p)),
union_words AS (SELECT example_id, r[j] AS w, count(*) AS n FROM passed GROUP BY 1, 2),
pred_words AS (SELECT example_id, w, count(*) AS n FROM (SELECT example_id, unnest(flatten(ps)) AS w FROM cut) GROUP BY 1, 2),
lsum AS (SELECT example_id, coalesce(h, 0) AS h, coalesce(len(flatten(ps)), 0) AS np, coalesce(len(flatten(rs)), 0) AS nr FROM cut LEFT JOIN (
  SELECT example_id, sum(least(u.n, p.n)) AS h FROM union_words u JOIN pred_words p USING (example_id, w) GROUP BY 1) USING (example_id))"""
LSUM_SQL = f"""WITH RECURSIVE {PAIRS}, {LSUM_TABLES}, scored AS (SELECT example_id, {scored_sql('rougeLsum')} FROM lsum)
SELECT example_id, {rounded_sql(['rougeLsum'])} FROM scored"""
REPORT_SQL = f"""WITH RECURSIVE {PAIRS}, {overlap_sql(1)}, {overlap_sql(2)}, {LCS_TABLES}, {LSUM_TABLES}, scored AS (
  SELECT * FROM (SELECT example_id, {scored_sql('rouge1')} FROM hits1) JOIN (SELECT example_id, {scored_sql('rouge2')} FROM hits2) USING (example_id)
  JOIN (SELECT example_id, {scored_sql('rougeL')} FROM lcs) USING (example_id) JOIN (SELECT example_id, {scored_sql('rougeLsum')} FROM lsum) USING (example_id))
SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in rouge.score_columns())} FROM scored"""


@query("e13_rouge_l", LCS_SQL)
def rouge_l(spark, sf_dir):
    return rounded(rouge.rouge_l(corpus.text_pairs(spark, sf_dir)))


@query("e14_rouge_lsum", LSUM_SQL)
def rouge_lsum(spark, sf_dir):
    return rounded(rouge.rouge_lsum(corpus.text_pairs(spark, sf_dir)))


NGRAM_KEYS = ("rouge1", "rouge2")
BOTH_SQL = f"""{REF_PAIRS}, {overlap_sql(1)}, {overlap_sql(2)}, scored AS (
  SELECT * FROM (SELECT example_id, ref_id, {scored_sql('rouge1')} FROM hits1)
  JOIN (SELECT example_id, ref_id, {scored_sql('rouge2')} FROM hits2) USING (example_id, ref_id))"""


@query(
    "e15_rouge_multi_ref_best",
    f"""WITH {BOTH_SQL} SELECT example_id, {rounded_sql(NGRAM_KEYS)} FROM scored
    QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY rouge1_fmeasure DESC, ref_id) = 1""",
)
def rouge_multi_ref_best(spark, sf_dir):
    return rounded(rouge.rouge_multi_ref(corpus.multi_ref_pairs(spark, sf_dir), "best", NGRAM_KEYS))


@query(
    "e15_rouge_multi_ref_avg",
    f"""WITH {BOTH_SQL} SELECT example_id, {', '.join(f'round(avg({c}), 6) AS {c}' for c in rouge.score_columns(NGRAM_KEYS))}
    FROM scored GROUP BY example_id""",
)
def rouge_multi_ref_avg(spark, sf_dir):
    return rounded(rouge.rouge_multi_ref(corpus.multi_ref_pairs(spark, sf_dir), "avg", NGRAM_KEYS))


@query("e16_rouge_report", REPORT_SQL)
def rouge_report(spark, sf_dir):
    return rounded(rouge.rouge_report(corpus.text_pairs(spark, sf_dir)))


def _rules_sql(rules, least: int) -> str:
    """The longest suffix that fits decides; ``k`` has the letters' kinds of ``w``."""
    arms = []
    for suffix, new in sorted(rules, key=lambda rule: -len(rule[0])):
        n = len(suffix)
        also = f" AND w[-{n + 1}] IN ('s', 't')" if suffix == "ion" else ""
        enough = f"len(regexp_extract_all(left(k, len(k) - {n}), 'v+c')) > {least}{also}"
        arms.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {enough} THEN left(w, len(w) - {n}) || '{new}' ELSE w END")
    return f"CASE {' '.join(arms)} ELSE w END"


def _step_sql(name: str, source: str, word: str) -> str:
    kinds = """list_reduce(string_split(w, ''), lambda acc, l: acc || CASE WHEN l IN ('a', 'e', 'i', 'o', 'u') OR (l = 'y' AND right(acc, 1) = 'c')
      THEN 'v' ELSE 'c' END, '')"""
    return f"{name} AS (SELECT token, w, {kinds} AS k FROM (SELECT token, {word} AS w FROM {source}))"


_PAST = "CASE WHEN NOT ends_with(w, 'eed') THEN CASE WHEN ends_with(w, 'ed') AND contains(left(k, len(k) - 2), 'v') THEN 2 WHEN ends_with(w, 'ing') AND contains(left(k, len(k) - 3), 'v') THEN 3 END END"
_SHORT = "regexp_matches(k, 'cvc$') AND NOT regexp_matches(w, '[wxy]$')"
_REPAIRED = f"""CASE WHEN w = uncut THEN CASE WHEN ends_with(w, 'eed') AND contains(left(k, len(k) - 3), 'vc') THEN left(w, len(w) - 1) ELSE w END
  WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
  WHEN w[-1] = w[-2] AND right(k, 1) = 'c' AND w[-1] NOT IN ('l', 's', 'z') THEN left(w, len(w) - 1)
  WHEN len(regexp_extract_all(k, 'v+c')) = 1 AND {_SHORT} THEN w || 'e' ELSE w END"""
STEMS_SQL = ", ".join(
    [
        _step_sql("stem0", "long_words", "token"),
        _step_sql("stem1a", "stem0", _rules_sql(stemming.STEP_1A, -1)),
        f"""past AS (SELECT token, w AS uncut, k AS uncut_k, {_PAST} AS n FROM stem1a),
        bare AS (SELECT token, uncut, CASE WHEN n IS NULL THEN uncut ELSE left(uncut, len(uncut) - n) END AS w,
          CASE WHEN n IS NULL THEN uncut_k ELSE left(uncut_k, len(uncut_k) - n) END AS k FROM past),
        repaired AS (SELECT token, uncut, {_REPAIRED} AS w FROM bare)""",
        _step_sql("stem1b", "repaired", "w"),
        _step_sql("stem1c", "stem1b", "CASE WHEN ends_with(w, 'y') AND contains(left(k, len(k) - 1), 'v') THEN left(w, len(w) - 1) || 'i' ELSE w END"),
        _step_sql("stem2", "stem1c", _rules_sql(stemming.STEP_2, 0)),
        _step_sql("stem3", "stem2", _rules_sql(stemming.STEP_3, 0)),
        _step_sql("stem4", "stem3", _rules_sql([(s, "") for s in stemming.STEP_4], 1)),
        f"""ending AS (SELECT token, w AS whole, left(w, len(w) - 1) AS w, left(k, len(k) - 1) AS k FROM stem4)""",
        _step_sql(
            "stem5a",
            "ending",
            f"""CASE WHEN ends_with(whole, 'e') AND (len(regexp_extract_all(k, 'v+c')) > 1
              OR (len(regexp_extract_all(k, 'v+c')) = 1 AND NOT ({_SHORT}))) THEN w ELSE whole END""",
        ),
        "stem5 AS (SELECT token, CASE WHEN ends_with(w, 'll') AND len(regexp_extract_all(k, 'v+c')) > 1 THEN left(w, len(w) - 1) ELSE w END AS stem FROM stem5a)",
    ]
)


@query(
    "e18_porter_stem",
    f"""WITH counted AS (SELECT token, count(*) AS n FROM (SELECT unnest({sql.rouge_tokens('text')}) AS token FROM documents) GROUP BY token),
    long_words AS (SELECT token FROM counted WHERE len(token) >= {stemming.SHORTEST}), {STEMS_SQL}
    SELECT coalesce(stem, token) AS stem, count(*) AS n_words, sum(n)::BIGINT AS n_uses FROM counted LEFT JOIN stem5 USING (token) GROUP BY 1""",
)
def porter_stem(spark, sf_dir):
    """Stems of all words of the documents; every different word is stemmed once."""
    words = encoding.token_counts(corpus.documents(spark, sf_dir), ["text"], rouge_tokens)
    stems = words.select(stemming.stem_word("token").alias("stem"), "n")
    return stems.groupBy("stem").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_uses"))


@query(
    "e18_rouge_stemmed",
    f"""WITH {PAIRS.replace("pairs AS", "plain AS")},
    long_words AS (SELECT DISTINCT token FROM (SELECT unnest(list_concat(p, r)) AS token FROM plain) WHERE len(token) >= {stemming.SHORTEST}), {STEMS_SQL},
    sides AS (SELECT example_id, ref_id, 'p' AS side, unnest(p) AS token FROM plain UNION ALL SELECT example_id, ref_id, 'r', unnest(r) FROM plain),
    stemmed AS (SELECT example_id, ref_id, list(coalesce(stem, token)) FILTER (side = 'p') AS p, list(coalesce(stem, token)) FILTER (side = 'r') AS r
      FROM sides LEFT JOIN stem5 USING (token) GROUP BY 1, 2),
    pairs AS (SELECT example_id, ref_id, coalesce(s.p, []) AS p, coalesce(s.r, []) AS r FROM plain LEFT JOIN stemmed s USING (example_id, ref_id)),
    {overlap_sql(1)}, scored AS (SELECT example_id, {scored_sql('rouge1')} FROM hits1)
    SELECT example_id, {rounded_sql(['rouge1'])} FROM scored""",
)
def rouge_stemmed(spark, sf_dir):
    return rounded(rouge.rouge_n(corpus.text_pairs(spark, sf_dir), 1, use_stemmer=True))


@query("e18_rouge_report_stemmed")
def rouge_report_stemmed(spark, sf_dir):
    """The whole report with stems on; a test holds it against the plain report of texts stemmed beforehand."""
    return rounded(rouge.rouge_report(corpus.text_pairs(spark, sf_dir), use_stemmer=True))


@query("e17_rouge_from_ids")
def rouge_from_ids(spark, sf_dir):
    """Both sides encoded by a vocabulary of their own ROUGE tokens, then decoded and scored."""
    pairs = corpus.text_pairs(spark, sf_dir)
    table = encoding.build_vocab(pairs, ["pred", "ref"], tokenizer=rouge_tokens)
    vocab = encoding.load_codec(table)
    tokens = pairs.select(
        "example_id", rouge_tokens(F.col("pred")).alias("p"), rouge_tokens(F.col("ref")).alias("r")
    )
    rows = encoding.encode(tokens, vocab, {"p": "preds", "r": "labels"}).select("example_id", "preds", "labels")
    return rounded(evaluation.rouge_from_ids(stored(rows), vocab))


@query("e19_evaluate_by_mode")
def evaluate_by_mode(spark, sf_dir):
    logits, labels = corpus.token_preds(spark, sf_dir)
    report = evaluation.evaluate_by_mode(logits, labels, corpus.text_pairs(spark, sf_dir))
    return report.withColumn("value", F.round("value", 6))
