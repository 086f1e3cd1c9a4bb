"""The registered pipeline, its stages held against brute force on the small tables."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sheafwork.llm import conv, queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mix", "encode"]
    kept = [r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, sf_dir).select("doc_id").collect()]
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(" ".join(r["text"].replace("\n", " ").split()), r["doc_id"])
    assert len(kept) >= len(first) and set(first.values()) <= set(kept)
    done = corpus_pipeline.run(spark, sf_dir)
    assert done.columns == [*columns, "ids", "decoded", "n_tokens"]
    rows = done.select("doc_id", "n_tokens", F.octet_length("ids").alias("b")).collect()
    assert rows and all(r["b"] == 4 * r["n_tokens"] for r in rows)
    assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 2


@pytest.mark.parametrize("shift", [-1.0, 1.0])
def test_toxicity_rejects_at_the_calibrated_threshold_in_both_directions(spark, odd, monkeypatch, shift):
    """All scores are on one side of one half, and each language's threshold just below or above its text's score."""
    net = conv.Network.new(3)
    net.scale = (0.01, shift)
    docs = odd.where("doc_id in (1, 5, 6, 8)")
    scores = {r["lang"]: r["score"] for r in conv.scored(docs.drop("score"), net).collect()}
    assert len(scores) == 4 and all((s > 0.5) == (shift > 0) for s in scores.values())
    monkeypatch.setattr(corpus_pipeline, "toxicity_network", lambda *_: net)
    for step, left in ((-0.02, 0), (0.02, 4)):
        net.thresholds = {lang: s + step for lang, s in scores.items()}
        assert corpus_pipeline.toxicity(spark, docs, "").count() == left


def test_toxicity_on_held_out_documents_of_classes_that_overlap(spark, tmp_path):
    """Toxic documents all have a word that a tenth of the clean ones has too, so their calibrated score is below one half."""
    random.seed(8)
    common = ["sun", "tree", "river", "stone", "house", "road"]
    rows = []
    for i in range(4000):
        toxic = int(i % 20 == 0)
        words = [random.choice(common) for _ in range(12)]
        if toxic or random.random() < 0.1:
            words[random.randrange(12)] = "grubby"
        rows.append((i, " ".join(words), "en", "s", 0, toxic))
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int")
    made.drop("toxic").write.parquet(f"{tmp_path}/documents.parquet")
    made.select("doc_id", F.lit(1).alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, made.drop("toxic"), str(tmp_path)).collect()}
    held_out = made.where(queries._fold(5) == 0).collect()
    toxic = [r["doc_id"] in left for r in held_out if r["toxic"]]
    clean = [r["doc_id"] in left for r in held_out if not r["toxic"]]
    assert len(toxic) > 20 and sum(toxic) <= 0.1 * len(toxic)
    assert sum(clean) >= 0.8 * len(clean)
