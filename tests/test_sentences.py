"""Abbreviations learned from a corpus, and sentences cut with them."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sheafwork.functions import text as tx
from sheafwork.operators import encoding, rouge, sentences

CORPUS = [
    "Dr. Stone met Dr. Field. They spoke for an hour about the work of the day.",
    "Then Dr. Field left the house and the garden. The garden was in bloom!",
    "In the U.S. the law of the land was new.\nDr. Stone read the law of the U.S. in the garden, e.g. at noon",
    "The house, e.g. the garden of the house, was old... The work went on? (Dr.) Stone stayed. 3.5 and 12. were numbers.",
    "",
    None,
] * 4


def by_brute_force(texts):
    counts = {True: Counter(), False: Counter()}
    for word in (w for t in texts for w in re.split(r"[ \t\r\n\f]+", t or "") if w):
        bare = word
        while bare and not bare[0].isalnum():
            bare = bare[1:]
        while bare and not (bare[-1].isalnum() or bare[-1] == "."):
            bare = bare[:-1]
        bare = bare.lower()
        kind = bare[:-1] if bare.endswith(".") else bare
        if kind:
            counts[bare.endswith(".")][kind] += 1
    n_with, n_without = (sum(counts[b].values()) for b in (True, False))
    p = n_with / (n_with + n_without)
    found = {}
    for kind in counts[True].keys() | counts[False].keys():
        k, rest = counts[True][kind], counts[False][kind]
        letters = kind.replace(".", "")
        if not letters.isalpha() or kind.startswith(".") or kind.endswith(".") or ".." in kind:
            continue
        null = k * math.log(p) + rest * math.log(1 - p)
        other = k * math.log(0.99) + rest * math.log(0.01)
        score = -2 * (null - other) * math.exp(-len(letters)) * (kind.count(".") + 1) / len(letters) ** rest
        if score >= sentences.LEAST_SCORE:
            found[kind] = (k, rest, score)
    return found


def test_counts_and_scores(spark):
    docs = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    got = {r["word"]: (r["n_with"], r["n_without"], r["score"]) for r in sentences.abbreviations(docs).collect()}
    want = by_brute_force(CORPUS)
    assert got.keys() == want.keys() and {"dr", "u.s", "e.g"} <= got.keys() and "garden" not in got
    for word, values in want.items():
        assert got[word] == pytest.approx(values)


def test_a_corpus_without_periods_has_none(spark):
    for rows in ([], [("no period here",)], [("!",), (None,)]):
        assert sentences.abbreviations(spark.createDataFrame(rows, "text string")).count() == 0


@pytest.mark.parametrize("bound", [0, 1, encoding.HEAD_ROWS])
def test_cuts(spark, bound):
    table = spark.createDataFrame([("dr", 0), ("e.g", 1)], "token string, id int")
    texts = ["Dr. X went. He saw (Dr. Y), e.g. here.\nDr.\nEnd", "a! Dr. b? dr. c", "", None, " . ", "one. two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    codec = encoding.load_codec(table, bound)
    got = {r["id"]: r["s"] for r in sentences.split_trained(docs, codec, {"text": "s"}).collect()}
    assert got[0] == ["Dr. X went.", "He saw (Dr. Y), e.g. here.", "Dr.", "End"]
    assert got[1] == ["a!", "Dr. b?", "dr. c"] and got[2] == [] and got[3] is None and got[5] == ["one.", "two"]


def test_without_abbreviations_cuts_as_before(spark):
    texts = ["a. b \n c.\n d! \t\r\n\n e?f. ", "x.\x0c y", "\n", "", "...", ". . ."]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    none = spark.createDataFrame([], "word string, n_with long")
    rows = sentences.split_trained(docs, none, {"text": "s"}).select("s", tx.split_sentences(F.col("text")).alias("plain")).collect()
    assert len(rows) == 6 and all(r["s"] == r["plain"] for r in rows)


def test_lsum_takes_them(spark):
    pairs = spark.createDataFrame([(1, "Dr. X", "X Dr.")], "example_id long, pred string, ref string")
    known = spark.createDataFrame([("dr", 3)], "word string, n_with long")
    cut = sentences.split_trained(pairs, known, {"pred": "p", "ref": "r"})
    whole = rouge.rouge_lsum(cut, sentences=("p", "r")).first()
    assert whole["rougeLsum_fmeasure"] == 0.5 and rouge.rouge_lsum(pairs).first()["rougeLsum_fmeasure"] == 1.0
