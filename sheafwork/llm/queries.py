"""The registered queries of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import bpe, conv, exact_dedup, fill_middle, manifest, merkle, mixed_packing, mixing, near_dedup, ranking, repeats, revisits, url_model
from sheafwork.llm.common import keep, new_folder
from sheafwork.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tree_sql(text: str, to: str) -> str:
    """Leaves of a text by section and paragraph, as lists of digests."""
    leaf = merkle.LEAF
    leaves = f"[sha256(l) for l in regexp_extract_all(p, '{leaf}')]"
    return f"[[{leaves} for p in string_split(s, chr(10))] for s in string_split({text}, chr(10) || chr(10))] AS {to}"


def _paragraphs_sql(section: str) -> str:
    return f"[sha256('p' || coalesce(array_to_string(p, ''), '')) for p in {section}]"


def _first_sql(a: str, b: str) -> str:
    """Place from 0 of the first elements that differ, -1 if none do."""
    same = f"list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] IS NOT DISTINCT FROM {b}[i])"
    return f"(coalesce(list_position({same}, false), 0) - 1)::INT"


def _root_sql(tree: str) -> str:
    section = f"sha256('s' || array_to_string({_paragraphs_sql('s')}, ''))"
    return f"sha256('d' || array_to_string([{section} for s in {tree}], ''))"


def _near_sql(a: str, ra: str, b: str, rb: str) -> str:
    return f"2.0::DOUBLE * (len(list_intersect({a}, {b})) + ({ra} = {rb})::INT) / (len({a}) + len({b}) + 2)"


MERKLE_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS later, first(coalesce(text, '')) OVER (ORDER BY doc_id) AS first_text
  FROM documents),
e AS (
  SELECT doc_id, n, text, coalesce(later, first_text) AS next_text,
         substr(text, 1, n - n // 2) || substr(coalesce(later, first_text), 1, n // 2) AS edited
  FROM t),
k AS (SELECT *, {_tree_sql("text", "l0")}, {_tree_sql("edited", "l1")}, {_tree_sql("next_text", "l2")} FROM e),
r AS (
  SELECT doc_id, n, edited, l0, l1, [sha256('s' || array_to_string({_paragraphs_sql('s')}, '')) for s in l0] AS s0,
         [sha256('s' || array_to_string({_paragraphs_sql('s')}, '')) for s in l1] AS s1, {_root_sql("l0")} AS r0, {_root_sql("l1")} AS r1, {_root_sql("l2")} AS r2,
         list_distinct(flatten(flatten(l0))) AS a, list_distinct(flatten(flatten(l1))) AS b, list_distinct(flatten(flatten(l2))) AS c
  FROM k),
sections AS (SELECT *, {_first_sql("s0", "s1")} AS sec FROM r),
paragraphs AS (SELECT *, {_paragraphs_sql("l0[sec + 1]")} AS p0, {_paragraphs_sql("l1[sec + 1]")} AS p1 FROM sections),
places AS (SELECT *, CASE WHEN len(l0) <= sec OR len(l1) <= sec THEN -1 ELSE {_first_sql("p0", "p1")} END AS par FROM paragraphs),
leaves AS (SELECT *, CASE WHEN par < 0 OR len(p0) <= par OR len(p1) <= par THEN -1
  ELSE {_first_sql("l0[sec + 1][par + 1]", "l1[sec + 1][par + 1]")} END AS leaf FROM places)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, r0 AS fingerprint, r1 AS edited_fingerprint,
       {_near_sql("a", "r0", "b", "r1")} AS near_edited, {_near_sql("a", "r0", "c", "r2")} AS near_next,
       CASE WHEN sec >= 0 THEN sec END AS edit_section, CASE WHEN sec >= 0 THEN par END AS edit_paragraph, CASE WHEN sec >= 0 THEN leaf END AS edit_leaf
FROM leaves
"""


@query("op6_merkle_fingerprints", MERKLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle roots of every text and of its edit, and how alike they are."""
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""


@query("op10_exact_duplicates", EXACT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are copies of which, by names of blocks."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


WORD_BPE = "word_bpe_49k.json"


@query("op7_word_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of what they decode to."""
    path = public_tokenizers.path(WORD_BPE)
    decoded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_entropy_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", "copies")


@query("op5_url_character_models")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL, by rule or by the ratio of two character models."""
    return url_model.judge(table(spark, sf_dir, "pages"))


def _fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


def toxicity_network(spark: SparkSession, sf_dir: str) -> conv.Network:
    """Trained on the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    return conv.learn(table(spark, sf_dir, "documents"), labels)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; ``threshold`` is the language's, for decisions."""
    net = toxicity_network(spark, sf_dir)
    docs = conv.scored(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), net)
    return docs.select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), conv.threshold_of(net, F.col("lang")).alias("threshold")
    )


@query("op2_pairwise_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from pairs of labelled documents."""
    labels = table(spark, sf_dir, "labels").where(_fold(4) != 2).select("doc_id", F.col("quality").alias("label"))
    documents = table(spark, sf_dir, "documents")
    ranker = ranking.learn(documents, labels)
    ranked = keep(ranking.worths(documents.select("doc_id", "text"), ranker).select("doc_id", "worth"), new_folder(spark), "worths")
    docs = ranked.withColumn("score", ranking.score_of(ranking.cut_at_quantile(ranked, ranker)))
    return docs.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= ranking.KEEP_AT).cast("int").alias("predicted"))


@query("op4_dart_near_duplicates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query("op3_repeated_passages")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without passages that documents with smaller ids have."""
    done = repeats.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_CANONICAL_SQL = r"""
CASE WHEN regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1) = '' THEN bare
ELSE lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) || '://'
  || regexp_extract(regexp_extract(bare, '^[^:]*://([^/?]*)', 1), '^(.*@)', 1)
  || regexp_replace(lower(regexp_replace(regexp_extract(bare, '^[^:]*://([^/?]*)', 1), '^.*@', '')),
       CASE lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '')
  || CASE WHEN regexp_extract(bare, '^[^:]*://[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(bare, '^[^:]*://[^/?]*([^?]*)', 1) END
  || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END
"""
REVISIT_SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, regexp_replace(coalesce(url, ''), '#.*$', '') AS bare, page_id * 600 AS t,
         sha256(coalesce(html, '')) AS sha, length(coalesce(html, ''))::VARCHAR AS size FROM pages),
r AS (
  SELECT page_id * 4 AS record_id, true AS full, url AS uri, t AS time, '"' || sha[1:16] || '"' AS etag, t::VARCHAR AS lm,
         'max-age=60' AS cc, size, NULL AS expires, sha FROM p
  UNION ALL SELECT page_id * 4 + 3, true, url, t + 129600, '"v2-' || sha[1:12] || '"', (t + 129600)::VARCHAR, 'max-age=60', size, NULL, sha FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT page_id * 4 + 1, false,
         upper(regexp_extract(url, '^([^:]*://[^/?#]*)', 1)) || CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END
           || regexp_extract(bare, '^[^:]*://[^/?#]*(.*)$', 1) || '#again',
         t + 86400, CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/"' || sha[1:16] || '"' END, NULL, 'max-age=120', '0', NULL, sha FROM p
  UNION ALL SELECT page_id * 4 + 2, false, bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_medium=mail',
         CASE WHEN page_id % 7 = 0 THEN t - 60 ELSE t + 172800 END, NULL, (CASE WHEN page_id % 3 = 0 THEN t + 129600 ELSE t END)::VARCHAR, NULL, NULL,
         (CASE WHEN page_id % 7 = 0 THEN t - 60 ELSE t + 172800 END + 60)::VARCHAR, sha FROM p),
b AS (SELECT *, regexp_replace(uri, '#.*$', '') AS bare FROM r),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS params FROM b),
k AS (SELECT *, {_CANONICAL_SQL} AS url FROM q),
best AS (
  SELECT v.record_id, max(struct_pack(time := f.time, record_id := f.record_id)).record_id AS ref_id
  FROM k v JOIN k f ON v.url = f.url AND f.time < v.time WHERE f.full AND NOT v.full GROUP BY v.record_id),
j AS (
  SELECT v.record_id, v.url, m.ref_id, v.etag, v.lm, v.cc, v.size, v.expires, v.time, f.etag AS fetag, f.lm AS flm, f.cc AS fcc, f.size AS fsize, f.sha AS fsha,
         CASE WHEN m.ref_id IS NULL THEN 'orphan' WHEN v.etag IS NOT NULL THEN CASE WHEN regexp_replace(v.etag, '^W/', '') = f.etag THEN 'resolved' ELSE 'mismatch' END
              WHEN v.lm = f.lm THEN 'resolved' ELSE 'mismatch' END AS verdict
  FROM k v LEFT JOIN best m USING (record_id) LEFT JOIN k f ON f.record_id = m.ref_id WHERE NOT v.full)
SELECT record_id, url AS uri, ref_id, verdict,
  CASE WHEN verdict = 'resolved' THEN concat_ws(chr(10), 'cache-control: ' || coalesce(cc, fcc), 'content-length: ' || fsize, 'content-type: text/html', 'date: ' || time, 'etag: ' || coalesce(etag, fetag), 'expires: ' || expires, 'last-modified: ' || flm)
       WHEN etag IS NOT NULL THEN concat_ws(chr(10), 'cache-control: ' || cc, 'connection: close', 'content-length: 0', 'date: ' || time, 'etag: ' || etag)
       ELSE concat_ws(chr(10), 'date: ' || time, 'expires: ' || expires, 'last-modified: ' || lm) END AS headers,
  CASE WHEN verdict = 'resolved' THEN fsha END AS payload_sha256
FROM j
"""


@query("op1_warc_revisits", REVISIT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit made from the pages, with the response that it confirms and its merged headers."""
    records = revisits.captures(table(spark, sf_dir, "pages"))
    found = revisits.resolve(records, carry=("payload_sha256",))
    return found.select("record_id", "uri", "ref_id", "verdict", revisits.header_lines(F.col("headers")).alias("headers"), "payload_sha256")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of each tree in the SQL: enough for 16 ** 7 rows of a source, and as many sources.
_SQL_LEVELS = 7


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _manifest_sql() -> str:
    """Both trees level by level, then every leaf's way up, one level after the other."""
    fields = [_field_sql(f) for f in manifest.FIELDS]
    other = [*fields[:-1], _field_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")]
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295)"
    parts = [
        f"""l AS (SELECT doc_id, coalesce('=' || source, '-') AS g, sha256({" || ".join(fields)}) AS d,
      CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({" || ".join(other)}) ELSE sha256({" || ".join(fields)}) END AS seen FROM documents)""",
        """a0 AS (SELECT doc_id, g, d, seen, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l)""",
    ]

    def tree(name: str) -> None:
        for k in range(_SQL_LEVELS):
            parts.append(f"{name}r{k} AS (SELECT g, i // 16 AS j, list(d ORDER BY i) AS ds, any_value(n) AS n FROM {name}{k} GROUP BY g, i // 16)")
            parts.append(f"{name}{k + 1} AS (SELECT g, j AS i, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, (n + 15) // 16 AS n FROM {name}r{k})")

    def way(name: str, start: str, group: str) -> None:
        parts.append(start)
        for k in range(_SQL_LEVELS):
            sides = "array_to_string(r.ds[1:w.i % 16], '') AS lo, array_to_string(r.ds[w.i % 16 + 2:], '') AS hi"
            parts.append(
                f"""{name}{k + 1} AS (SELECT doc_id, leaf, g, i // 16 AS i, subroot, CASE WHEN n = 1 THEN cur ELSE sha256(lo || cur || hi) END AS cur, sib || lo || hi AS sib
      FROM (SELECT w.*, r.n, {sides} FROM {name}{k} w JOIN {group}r{k} r ON r.g = w.g AND r.j = w.i // 16))"""
            )

    tree("a")
    parts.append(f"s AS (SELECT g AS own, d FROM a{_SQL_LEVELS})")
    parts.append("b0 AS (SELECT own, '' AS g, d, row_number() OVER (ORDER BY own) - 1 AS i, count(*) OVER () AS n FROM s)")
    tree("b")
    way("u", "u0 AS (SELECT a0.doc_id, a0.d AS leaf, a0.g, a0.i, s.d AS subroot, a0.seen AS cur, '' AS sib FROM a0 JOIN s ON s.own = a0.g)", "a")
    way("v", f"v0 AS (SELECT u.doc_id, u.leaf, b0.g, b0.i, u.subroot, u.cur, u.sib FROM u{_SQL_LEVELS} u JOIN b0 ON b0.own = u.g)", "b")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"\nSELECT v.doc_id, v.leaf, v.subroot, r.d AS root, sha256(v.sib) AS proof_sha256, v.cur AS folded_root, v.cur = r.d AS verified FROM v{_SQL_LEVELS} v JOIN b{_SQL_LEVELS} r USING (g)"
    )


MANIFEST_SQL = _manifest_sql()


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion proofs of all documents; of every fifth, a reader finds a text in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest.verified(manifest.proofs(table(spark, sf_dir, "documents"), tampered=tampered))


@query("op12_mixture_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pieces of all documents lie in sequences of 2048 tokens."""
    done = mixed_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return done.select("doc_id", "start", "length", mixed_packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op13_fill_in_middle")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle at the end, and the text rebuilt from that."""
    done = fill_middle.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
