"""Manifest proofs against a plain tree."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from sheafwork.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """The root, and the way of every leaf as (left, right) strings."""
    ways, at, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for w, way in enumerate(ways):
            first = at[w] // 16 * 16
            way.append(("".join(nodes[first : at[w]]), "".join(nodes[at[w] + 1 : first + 16])))
            at[w] //= 16
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return (nodes[0] if nodes else None), ways


def expected(rows):
    sources = collections.defaultdict(list)
    for r in rows:
        leaf = H(*map(field, r[:5]))
        lower = None if r[4] is None else "".join(c.lower() if c.isascii() else c for c in r[4])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        sources[r[1]].append((r[0] is not None, r[0], leaf, H(*map(field, (*r[:4], lower))) if hit else leaf))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: tree([x[2] for x in sorted(sources[s])]) for s in order}
    root, above = tree([own[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (_, i, leaf, seen), way in zip(sorted(sources[s]), own[s][1]):
            done = seen
            for left, right in [*way, *up]:
                done = H(left, done, right)
            out.append((i, leaf, own[s][0], root, H(*(x for w in [*way, *up] for x in w)), done, done == root))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = manifest.verified(manifest.proofs(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {"a": 16}, {"a": 17}, {None: 1, "a": 1}, {"a": 700, None: 3, "": 40, "é": 1, "b": 16}])
def test_equals_plain_tree(spark, sizes):
    random.seed(3)
    rows = []
    for s, n in sizes.items():
        rows += [(random.randrange(10**6), s, random.choice(["en", None]), random.choice([None, 5]), random.choice(["Abc É", "", None, "xyz"])) for _ in range(n)]
    random.shuffle(rows)
    check(spark, rows)


def test_many_sources_repeated_rows_and_null_ids(spark):
    rows = [(i, f"s{i % 300}", "en", 1, "Text") for i in range(620)]
    rows += [(5, "s5", "en", 1, "Text")] * 40 + [(None, "s5", None, None, None)] * 3
    check(spark, rows)
