"""Fill-in-the-middle against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from sheafwork.llm import fill_middle


def plain(i, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'-' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs, **options):
    done = fill_middle.transformed(docs, **options)
    rows = done.withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], **options)
        assert r["back"] == (r["text"] or "")
    return rows


def test_odd_rows(odd, none):
    assert fill_middle.transformed(odd).columns == [*odd.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    check(odd)
    assert fill_middle.transformed(none).count() == 0
    clash = odd.withColumn("n", F.lit("x")).withColumn("output", F.lit(1))
    assert "x" not in {r["n"] for r in check(clash)}
    with pytest.raises(ValueError):
        fill_middle.transformed(odd, out="text")


@pytest.mark.parametrize("options", [{}, {"rate": 30, "spm": 80, "seed": 3}])
def test_random_texts(spark, options):
    random.seed(9)
    shared = "".join(random.choice("ab é😀\n") for _ in range(9000))
    rows = []
    for i in range(300):
        kind = random.random()
        text = "".join(random.choice("ab\n\né中<PSM>") for _ in range(random.randint(0, 60)))
        if kind < 0.3:
            text += shared[random.randint(0, 3000) :] + text
        elif kind < 0.4:
            text = "\n" * random.randint(0, 9)
        elif kind < 0.5:
            text = random.choice(["<", "x<S", "<P", "S>", ">"]) + "\n" + random.choice(["<M", "P>", "\n<S\n"])
        rows.append((i, text))
    forms = {r["form"] for r in check(spark.createDataFrame(rows, "doc_id long, text string"), **options)}
    assert forms == {"plain", "psm", "spm"}


def test_markers_and_characters_across_borders():
    """Every border of small chunks splits something."""
    text = ("é<M>x\n" * 40 + "😀" * 30).encode()
    for least in range(1, 9):
        cut = fill_middle.Cut(text, fill_middle.Chunks(), window=4, mean=3, least=least, most=least + 2)
        assert cut.whole.marked and cut.whole.chars == len(text.decode()) and cut.units() == 41
        assert [cut.place(u) for u in range(42)] == [(7 * u, 6 * u) for u in range(41)] + [(len(text), 270)]
    clean = b"<M" + b"a>" * 50 + b"<<MM>>"
    assert not fill_middle.Cut(clean, fill_middle.Chunks(), window=4, mean=3, least=1, most=2).whole.marked


def test_shared_passages_share_chunks():
    rng = np.random.default_rng(1)
    shared = rng.integers(32, 126, 1 << 20, dtype=np.uint8).tobytes()
    chunks = fill_middle.Chunks()
    fill_middle.Cut(b"one " + shared, chunks)
    sizes = [len(c) for c in chunks.known]
    assert 1000 < np.mean(sizes) < 4000 and max(sizes) <= fill_middle.MOST
    before = chunks.hits
    fill_middle.Cut(b"another begin " + shared, chunks)
    assert chunks.hits - before > 0.95 * len(sizes)


def test_the_memory_is_bounded():
    chunks = fill_middle.Chunks(limit=1000)
    for i in range(50):
        assert chunks.summary(str(i).encode() * 60).lines == 0
        assert sum(map(len, chunks.known)) <= 1000


def test_a_text_of_64_megabytes(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('some words in a line\n', 3200000)").alias("text"))
    r = fill_middle.transformed(docs).select("n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("s")).first()
    want = plain(0, "some words in a line\n" * 3200000)
    assert tuple(r)[:4] == want[:4] and r["s"] == hashlib.sha256(want[4].encode()).hexdigest()
