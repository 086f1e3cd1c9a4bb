import math
import random
import tracemalloc
from collections import Counter

import pytest
from __spark_entry__ import queries
from pyspark.sql import functions as F

from sheafwork.functions import arrays, scores
from sheafwork.operators import encoding, filters, labels, metrics, rouge, stats
from sheafwork.plans import builders, evaluation
from sheafwork.streaming import running


def test_length_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 12)], "n int")
    values = [r["value"] for r in stats.length_percentiles(df).collect()]
    assert values == [1, 2, 6, 9, 10, 10.5, 10.7, 10.8, 10.9, 11]


def test_truncation_loss_and_share(spark):
    df = spark.createDataFrame([(2,), (4,), (10,)], "n int")
    row = stats.truncation_loss(df, 4).first()
    assert (row["rows_cut"], row["ids_cut"]) == (pytest.approx(1 / 3), 6 / 16)
    assert stats.share_below(df, 4).first()["share"] == pytest.approx(1 / 3)


def test_accuracy_and_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "label int, pred int")
    assert metrics.accuracy(df).first()["accuracy"] == 0.5
    assert metrics.macro_f1(df, 4).first()["macro_f1"] == pytest.approx(0.388889, abs=1e-6)
    assert metrics.macro_f1(df, 4, "zero").first()["macro_f1"] == pytest.approx(0.291667, abs=1e-6)
    with pytest.raises(ValueError, match="absent"):
        metrics.macro_f1(df, 4, "other")


def test_multilabel(spark):
    df = spark.createDataFrame([([2.0, -1.0], [1.0, 0.0]), ([-0.5, 0.3], [0.0, 0.0])], "logits array<double>, targets array<float>")
    cells = df.select(scores.binarize(F.col("logits")).alias("pred"), scores.targets_to_int(F.col("targets")).alias("target"))
    assert [r["pred"] for r in cells.collect()] == [[1, 0], [0, 1]]
    assert metrics.multilabel_accuracy(cells).first()["accuracy"] == 0.75
    assert metrics.multilabel_macro_f1(cells, 2).first()["macro_f1"] == 0.5


def test_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0], 1)], "logits array<double>, label int")
    assert metrics.cross_entropy(df).first()["cross_entropy"] == pytest.approx(0.407606, abs=1e-6)


def test_cross_entropy_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1000.0], 0), ([-math.inf, 2.0], 1), ([-1000.0, -1000.0], 1)], "logits array<double>, label int")
    got = [r["l"] for r in df.select(scores.cross_entropy(F.col("logits"), F.col("label")).alias("l")).collect()]
    assert got == pytest.approx([math.log(2), 0.0, math.log(2)])


def test_bce(spark):
    df = spark.createDataFrame([([0.0, 2.0], [1.0, 0.0])], "logits array<double>, targets array<double>")
    assert metrics.bce_with_logits(df).first()["bce"] == pytest.approx(1.410038, abs=1e-6)
    assert metrics.bce_with_logits(df, "sum").first()["bce"] == pytest.approx(2.820075, abs=1e-6)
    large = spark.createDataFrame([([800.0], [1.0])], "logits array<double>, targets array<double>")
    assert metrics.bce_with_logits(large).first()["bce"] == 0.0


def test_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), (None,)], "logits array<double>")
    assert [r["p"] for r in df.select(scores.argmax(F.col("logits")).alias("p")).collect()] == [1, None]


def test_lm_cross_entropy_skips_ignored(spark):
    logits = spark.createDataFrame([(1, p, [0.0, 1.0]) for p in range(4)], "example_id int, pos int, logits array<double>")
    rows = spark.createDataFrame([(1, [0, 1, -100, 0])], "example_id int, labels array<int>")
    losses = metrics.token_losses(logits, rows).orderBy("pos").collect()
    assert [(r["pos"], r["target"]) for r in losses] == [(0, 1), (2, 0)]


def test_label_list_names(spark):
    df = spark.createDataFrame([([0, 7, 99],)], "targets array<int>")
    assert labels.label_list_names(df, "unfair_tos").first()["label_names"] == ["Limitation of liability", "Arbitration", None]


TOY = {"rouge1": (0.8, 1.0, 0.6667), "rouge2": (0.6667, 1.0, 0.5), "rougeL": (0.8, 1.0, 0.6667), "rougeLsum": (0.8, 1.0, 0.6667)}


def pairs_of(spark, *pairs):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "example_id int, pred string, ref string")


def test_rouge_toy_pair(spark):
    report = rouge.rouge_report(pairs_of(spark, ("hello world", "hello world star"))).first().asDict()
    for key, (f, p, r) in TOY.items():
        assert math.isclose(report[f"{key}_fmeasure"], f, rel_tol=1e-4)
        assert math.isclose(report[f"{key}_precision"], p, rel_tol=1e-4)
        assert math.isclose(report[f"{key}_recall"], r, rel_tol=1e-4)
    assert set(report) == set(rouge.score_columns())


def test_rouge_l_against_lsum(spark):
    row = rouge.rouge_pairs(pairs_of(spark, ("The cat sat. A dog ran.", "The dog sat."))).first()
    assert [round(row[f"rougeL_{s}"], 4) for s in rouge.SCORES] == [0.4444, 0.3333, 0.6667]
    assert [round(row[f"rougeLsum_{s}"], 4) for s in rouge.SCORES] == [0.6667, 0.5, 1.0]


def test_rouge_of_empty_sides_is_zero(spark):
    rows = rouge.rouge_pairs(pairs_of(spark, ("", "a b"), ("a", None), ("", ""))).collect()
    assert len(rows) == 3 and all(row[c] == 0 for row in rows for c in rouge.score_columns())


def test_rouge_options(spark):
    pairs = pairs_of(spark, ("A,b", "a,c"))
    split = rouge.rouge_pairs(pairs, ("rouge1",), normalizer=lambda c: c, tokenizer=lambda c: F.split(c, ",")).first()
    assert split["rouge1_fmeasure"] == 0
    assert rouge.rouge_pairs(pairs, ("rouge3",)).first()["rouge3_recall"] == 0
    with pytest.raises(ValueError, match="unknown"):
        rouge.rouge_pairs(pairs, ("bleu",))
    with pytest.raises(ValueError, match="accumulate"):
        rouge.rouge_multi_ref(pairs, "worst")


def test_rouge_needs_no_shuffle(spark):
    plan = rouge.rouge_pairs(pairs_of(spark, ("a", "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_multiset_overlap_against_counters(spark):
    rng = random.Random(3)
    cases = [([rng.choice("aabcd") for _ in range(rng.randrange(30))], [rng.choice("abbe") for _ in range(rng.randrange(30))]) for _ in range(200)]
    cases += [([], []), (["a"] * 50, ["a"] * 20), (["a"], [])]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    for row in df.withColumn("n", arrays.multiset_overlap(F.col("a"), F.col("b"))).collect():
        assert row["n"] == sum((Counter(row["a"]) & Counter(row["b"])).values())


def test_gram_hits_against_counters(spark):
    """Short and empty sides, repeated tokens, and n-grams that no row is long enough for."""
    rng = random.Random(5)
    cases = [(" ".join(rng.choice("aabcd") for _ in range(rng.randrange(25))), " ".join(rng.choice("abbe") for _ in range(rng.randrange(25)))) for _ in range(150)]
    cases += [("", ""), ("a", ""), ("", "a b"), ("a a a a", "a a"), (None, "a")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "example_id int, pred string, ref string")
    for n in (1, 2, 4, 30):
        got = {r["example_id"]: r for r in rouge.rouge_n(df.repartition(3), n).collect()}
        for i, sides in enumerate(cases):
            pred, ref = ([tuple(t[k : k + n]) for k in range(len(t) - n + 1)] for t in ((s or "").split() for s in sides))
            hits = sum((Counter(pred) & Counter(ref)).values())
            assert got[i][f"rouge{n}_precision"] == pytest.approx(hits / max(len(pred), 1))
            assert got[i][f"rouge{n}_recall"] == pytest.approx(hits / max(len(ref), 1))


def test_alignment_is_reported_from_one_reading(spark):
    df = spark.createDataFrame([([0] * n,) for n in (0, 4, 6, 8, 8, 12)], "input_ids array<int>")
    report = filters.alignment_report(df, 4, 8)
    assert {(r["multiple"], r["aligned"]): r["n_rows"] for r in report.collect()} == {(4, True): 5, (4, False): 1, (8, True): 3, (8, False): 3}
    assert report._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert filters.alignment_report(df.where("false"), 4, 8).count() == 0


def table_of(a, b):
    """The usual quadratic table, with all cells."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
    return rows


def walk_back(a, b):
    rows, i, j, found = table_of(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(j - 1)
            i, j = i - 1, j - 1
        elif rows[i - 1][j] > rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def test_bit_rows_equal_the_table():
    rng = random.Random(5)
    for _ in range(2000):
        a = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(90))]
        want = table_of(a, b)[-1][-1]
        assert rouge.lcs_size(a, b) == want
        assert rouge.lcs_positions(a, b) == walk_back(a, b)
        assert rouge.lcs_positions(b, a) == walk_back(b, a)
        assert len(rouge.lcs_positions(a, b)) == want


def lsum_by_hand(pred, ref):
    """Hits of the summary-level score: each union token counts while both sides still have it."""
    p_left, r_left, hits = [w for s in pred for w in s], [w for s in ref for w in s], 0
    for sentence in ref:
        union = set()
        for other in pred:
            union |= walk_back(other, sentence)
        for j in sorted(union):
            if sentence[j] in p_left and sentence[j] in r_left:
                p_left.remove(sentence[j])
                r_left.remove(sentence[j])
                hits += 1
    return hits


def test_rouge_lsum_against_brute_force(spark):
    rng = random.Random(9)

    def side():
        return [[rng.choice("abcdef") for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 6))]

    cases = [(side(), side()) for _ in range(60)]
    texts = [tuple(" ".join(" ".join(s) + "." for s in part) for part in case) for case in cases]
    got = rouge.rouge_lsum(pairs_of(spark, *texts)).orderBy("example_id").collect()
    for row, (pred, ref) in zip(got, cases):
        hits = lsum_by_hand(pred, ref)
        assert row["rougeLsum_precision"] == pytest.approx(hits / sum(map(len, pred)))
        assert row["rougeLsum_recall"] == pytest.approx(hits / sum(map(len, ref)))


def test_multi_ref(spark):
    rows = [(1, 0, "a b", "c"), (1, 1, "a b", "a b"), (1, 2, "a b", "b a"), (2, 5, "x", "y")]
    df = spark.createDataFrame(rows, "example_id int, ref_id int, pred string, ref string")
    best = rouge.rouge_multi_ref(df, "best").orderBy("example_id").collect()
    assert (best[0]["rouge1_fmeasure"], best[0]["rouge2_fmeasure"], best[1]["rouge1_fmeasure"]) == (1.0, 1.0, 0.0)
    mean = rouge.rouge_multi_ref(df, "avg", ("rouge1", "rougeL")).orderBy("example_id").first()
    assert (mean["rouge1_fmeasure"], mean["rougeL_fmeasure"]) == (pytest.approx(2 / 3), pytest.approx(0.5))


def test_rouge_from_ids(spark):
    vocab = spark.createDataFrame([("<pad>", 0), ("hello", 11), ("world", 12), ("star", 13)], "token string, id int")
    df = spark.createDataFrame([(1, [11, 12, 0], [11, 12, 13, -100])], "example_id int, preds array<int>, labels array<int>")
    report = evaluation.rouge_from_ids(df, vocab).first()
    assert report["rouge1_fmeasure"] == pytest.approx(0.8) and report["rouge2_recall"] == pytest.approx(0.5)


def test_evaluate_by_mode(spark):
    logits = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [0.0, 0.0])], "example_id int, pos int, logits array<double>")
    rows = spark.createDataFrame([(1, [0, 1])], "example_id int, labels array<int>")
    report = evaluation.evaluate_by_mode(logits, rows, pairs_of(spark, ("hello world", "hello world star"))).collect()
    values = {(r["mode"], r["metric"]): r["value"] for r in report}
    assert values["clm", "cross_entropy"] == pytest.approx(math.log(2))
    assert values["seq2seq", "rouge1_fmeasure"] == pytest.approx(0.8) and len(values) == 13


def test_unmatched_rows(spark):
    left = spark.createDataFrame([(1,), (2,)], "example_id int")
    right = spark.createDataFrame([(2,), (3,)], "example_id int")
    got = {(r["example_id"], r["missing_from"]) for r in metrics.unmatched_rows(left, right).collect()}
    assert got == {(1, "targets"), (3, "preds")}


def test_running_metrics_equal_the_batch_form(spark, tmp_path):
    rows = [(i % 3, (i * i) % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "label int, pred int").repartition(4)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running.start_running_confusion(stream, "confusion_so_far", str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r["metric"]: r["value"] for r in running.compute(spark.table("confusion_so_far"), 3).collect()}
    assert got["accuracy"] == pytest.approx(metrics.accuracy(df).first()["accuracy"])
    assert got["macro_f1"] == pytest.approx(metrics.macro_f1(df, 3).first()["macro_f1"])


def test_builders_run_on_a_stream(spark, tmp_path):
    """With a loaded vocabulary a builder is a projection, on a stream as on a table."""
    vocab = encoding.load_codec(spark.createDataFrame([("a", 5), ("b", 6), ("TL;DR", 7)], "token string, id int"))
    rows = [(i, "t", "a b " * (i % 3), "b" * (i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "example_id bigint, title string, text string, summary string").repartition(4)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = builders.build_clm_table(stream, vocab, 8, 4)
    query = (
        table.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, builders.build_clm_table(df, vocab, 8, 4).collect())) and len(got) == 13


def test_rouge_from_ids_loses_no_words(spark, sf_dir):
    """Words that occur only capitalised or with punctuation are in the vocabulary too, so nothing is lost in decoding."""
    whole, decoded = (queries()[name](spark, sf_dir).first().asDict() for name in ("e16_rouge_report", "e17_rouge_from_ids"))
    kept = rouge.score_columns(("rouge1", "rouge2", "rougeL"))
    assert [decoded[c] for c in kept] == [whole[c] for c in kept]


def test_the_walk_back_is_the_same_in_blocks_of_any_size(monkeypatch):
    random.seed(5)
    for _ in range(300):
        a = [random.randrange(6) for _ in range(random.randint(0, 40))]
        b = [random.randrange(6) for _ in range(random.randint(0, 30))]
        whole = rouge.lcs_positions(a, b)
        assert whole == walk_back(a, b) == rouge.lcs_positions(a, b, row_bytes=0)
        with monkeypatch.context() as m:
            m.setattr(rouge, "SHORT", 0)
            m.setattr(rouge, "OFTEN", 2)
            assert rouge.lcs_positions(a, b) == whole and rouge.lcs_size(a, b) == len(whole)


def test_union_over_all_pairs_of_sentences():
    random.seed(6)
    for _ in range(300):
        preds = [[random.randrange(9) for _ in range(random.randint(0, 8))] for _ in range(random.randint(0, 7))]
        refs = [[random.randrange(12) for _ in range(random.randint(0, 9))] for _ in range(random.randint(0, 7))]
        want = []
        for ref in refs:
            places = set().union(*(walk_back(pred, ref) for pred in preds))
            want += [ref[j] for j in sorted(places)]
        assert rouge.union_tokens(preds, refs) == want


def test_a_sentence_of_200_000_words_in_bounded_memory():
    random.seed(7)
    pred = [random.randrange(30_000) for _ in range(200_000)]
    ref = [random.randrange(30_000) for _ in range(20_000)]
    tracemalloc.start()
    found = rouge.lcs_positions(pred, ref)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # One bit row for each predicted word would be 500 MB.
    assert len(found) == rouge.lcs_size(pred, ref) and peak < 60 << 20


def test_sentences_that_share_nothing_never_meet(monkeypatch):
    met = []
    real = rouge.lcs_positions
    monkeypatch.setattr(rouge, "lcs_positions", lambda p, r: met.append(1) or real(p, r))
    sentences = [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(2000)]
    assert rouge.union_tokens(sentences, sentences[::-1]) == [t for s in sentences[::-1] for t in s]
    assert len(met) == 2000
