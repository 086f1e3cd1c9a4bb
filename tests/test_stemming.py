"""Stems against word pairs that the published paper gives, and ROUGE with stems on."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sheafwork.functions import stemming
from sheafwork.functions.text import rouge_tokens
from sheafwork.operators import rouge

# Examples of the paper, through all steps.
PUBLISHED = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam",
    "operator": "oper", "hopefulness": "hope", "formality": "formal", "triplicate": "triplic", "formative": "form", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin", "replacement": "replac", "adoption": "adopt",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener",
    "oscillators": "oscil",
}


@pytest.mark.parametrize("word", PUBLISHED)
def test_published_pairs(word):
    assert stemming.stem(word) == PUBLISHED[word]


def test_short_words_and_odd_letters_stay():
    assert [stemming.stem(w) for w in ("", "as", "yes", "1990", "éé", "yyyy")] == ["", "as", "yes", "1990", "éé", "yyyi"]


def test_columns(spark):
    rows = spark.createDataFrame([(["cats", "as"], [["hopping"], []]), (None, None), ([], [])], "t array<string>, s array<array<string>>")
    got = [tuple(r) for r in rows.select(stemming.stem_tokens("t"), stemming.stem_sentences("s")).collect()]
    assert got == [(["cat", "as"], [["hop"], []]), (None, None), ([], [])]


def test_report_equals_the_report_of_stems(spark):
    text = "He was hopping. The relational cats\nagreed on goodness! Nothing else."
    pairs = spark.createDataFrame([(1, text, "Cats hop. It relates to good agreement."), (2, "", "x"), (3, None, "cats")], "example_id long, pred string, ref string")

    def by_hand(value):
        lines = [" ".join(stemming.stem(w) for w in "".join(c if c.isalnum() else " " for c in s.lower()).split()) for s in cut(value)]
        return "\n".join(lines)

    def cut(value):
        return (value or "").replace(". ", ".\n").replace("! ", "!\n").split("\n")

    stemmed = spark.createDataFrame([(r["example_id"], by_hand(r["pred"]), by_hand(r["ref"])) for r in pairs.collect()], pairs.schema)
    want = rouge.rouge_pairs(stemmed).orderBy("example_id").collect()
    assert rouge.rouge_pairs(pairs, use_stemmer=True).orderBy("example_id").collect() == want
    assert want[0]["rouge1_fmeasure"] > rouge.rouge_pairs(pairs).where("example_id = 1").first()["rouge1_fmeasure"] > 0


def test_a_word_of_the_report_is_stemmed_once(monkeypatch):
    text = pa.array([["hopping", "cats"], ["cats"]])
    lines = pa.array([[["hopping"], ["cats"]], [["cats"], []]])
    asked = []
    monkeypatch.setattr(rouge, "stem", lambda w: asked.append(w) or stemming.stem(w))
    got = rouge.token_hits([1, 2], True, True, True).func(text, pa.array([["cat", "hop"], ["cat"]]), lines, pa.array([[["cat", "hop"]], [["cat"]]]))
    assert got.to_pylist() == [{"hits1": 2, "hits2": 0, "hitsL": 1, "hitsLsum": 2}, {"hits1": 1, "hits2": 0, "hitsL": 1, "hitsLsum": 1}]
    assert sorted(asked) == ["cat", "cats", "hop", "hopping"]
    refs = pa.array([[["cat", "hop"]], [["cat"]]])
    assert rouge.token_hits([1, 2], True, True, True).func(lines, refs).to_pylist() == got.to_pylist()


def test_words_of_the_reader_come_stemmed(spark):
    row = spark.createDataFrame([("Ponies, ponies; PONY",)], "t string").select(stemming.stem_tokens(rouge_tokens(F.col("t")))).first()
    assert row[0] == ["poni", "poni", "poni"]
