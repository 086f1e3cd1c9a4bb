"""SQL fragments that the check queries share (DuckDB dialect)."""

from __future__ import annotations

from sheafwork.operators.encoding import SPECIALS
from sheafwork.plans import corpus

SPACE_SQL = "[ \\t\\r\\n\\f]+"


def case(column: str, values: dict, otherwise: str | None = None) -> str:
    def literal(v) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in values.items())
    return f"CASE {column} {arms}{f' ELSE {otherwise}' if otherwise else ''} END"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE_SQL}'), lambda w: w <> '')"


def normalized(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')"


def rouge_tokens(text: str) -> str:
    return f"list_filter(string_split({normalized(text)}, ' '), lambda w: w <> '')"


def sentences(text: str) -> str:
    marked = f"regexp_replace({text}, '([.!?]){SPACE_SQL}', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, '[\\r\\n]+', chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(10) || chr(12)) <> '')"


def repeat(value: int, n: str) -> str:
    return f"list_resize([]::INT[], greatest({n}, 0), {value})"


SUMMARIES = """
summaries AS (
  SELECT doc_id AS example_id, source AS title,
    CASE WHEN instr(text, chr(10)) = 0 THEN '' ELSE substr(text, instr(text, chr(10)) + 1) END AS text,
    CASE WHEN instr(text, chr(10)) = 0 THEN text ELSE substr(text, 1, instr(text, chr(10)) - 1) END AS summary
  FROM documents)"""

ADDRESSED = f"""
addressed AS (
  SELECT doc_id AS example_id, {case('source', corpus.TASK_OF_SOURCE, 'source')} AS task,
    {case('lang', corpus.SPLIT_OF_LANG)} AS split, {case('lang', corpus.TOKENIZER_OF_LANG)} AS tokenizer, text
  FROM documents)"""

VOCAB = f"""
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) + {len(SPECIALS) - 1})::INT AS id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest({words('text')}) AS token FROM documents)
        WHERE token NOT IN ({', '.join(f"'{s}'" for s in SPECIALS)})
        GROUP BY token)
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(SPECIALS))}) s(token, id))"""

CHOICES = """
offered AS (
  SELECT s.example_id - j AS example_id, md5(s.example_id::VARCHAR) AS at, s.example_id AS of, s.summary
  FROM summaries s, (SELECT unnest(range(5)) AS j)),
examples AS (
  SELECT s.example_id, any_value(s.text) AS context, list(o.summary ORDER BY o.at) AS endings,
    (list_position(list(o.of ORDER BY o.at), s.example_id) - 1)::INT AS label
  FROM summaries s JOIN offered o USING (example_id) GROUP BY s.example_id)"""


def encoded(source: str, tokens: str, out: str, name: str, key: str = "example_id") -> str:
    """CTE ``name(key, out)``: ids of the token lists of ``source``, unknown tokens as 1."""
    return f"""
{name} AS (
  SELECT s.{key}, coalesce(e.ids, []::INT[]) AS {out}
  FROM {source} s LEFT JOIN (
    SELECT t.{key}, list(coalesce(v.id, 1)::INT ORDER BY t.pos) AS ids
    FROM (SELECT {key}, unnest({tokens}) AS token, generate_subscripts({tokens}, 1) AS pos FROM {source}) t
    LEFT JOIN vocab v USING (token) GROUP BY t.{key}) e USING ({key}))"""
