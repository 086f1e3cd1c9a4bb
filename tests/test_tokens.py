from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafwork.functions import arrays
from sheafwork.functions.lists import ends, flat, packed, regroup, unpacked
from sheafwork.operators import encoding
from sheafwork.operators.encoding import PAD, SPECIALS, UNK
from sheafwork.plans import builders
from sheafwork.sources.tables import shared_dir

TEXTS = [(1, "b a a c"), (2, "c d b a"), (3, ""), (4, "zz a"), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "example_id bigint, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def longest_first(la, lb, budget):
    """Drop one id at a time from the longer side, ties from the second."""
    while la + lb > budget:
        if la > lb:
            la -= 1
        else:
            lb -= 1
    return la, lb


def test_vocab_order_and_bounds(spark, docs):
    vocab = encoding.build_vocab(docs, max_size=len(SPECIALS) + 3)
    got = [(r["token"], r["id"]) for r in vocab.orderBy("id").collect()]
    assert got == [*((s, i) for i, s in enumerate(SPECIALS)), ("a", 5), ("b", 6), ("c", 7)]
    frequent = encoding.build_vocab(docs, min_count=2)
    assert {r["token"] for r in frequent.collect()} == {*SPECIALS, "a", "b", "c"}


def test_many_tokens_of_one_count_and_head_are_numbered_by_ranges(spark, tmp_path):
    """100,000 tokens occur once and begin alike; they are spread over ranges, and ids are as in one sort."""
    df = spark.range(100_000).select(F.concat(F.lit("http"), F.col("id").cast("string"), F.lit(" twice twice")).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        vocab = encoding.build_vocab(df).persist()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    got = {r["token"]: r["id"] for r in vocab.collect()}
    want = [*SPECIALS, "twice", *sorted(f"http{i}" for i in range(100_000))]
    assert got == {token: i for i, token in enumerate(want)}
    folder = max(Path(shared_dir(spark)).glob("counts-*"), key=lambda p: p.stat().st_mtime)
    sizes = [r["count"] for r in spark.read.parquet(str(folder)).groupBy("part").count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == parts and max(sizes) < 2 * 100_001 / parts


def test_vocab_never_repeats_a_special(spark):
    df = spark.createDataFrame([("<pad> <pad> x",)], "text string")
    tokens = [r["token"] for r in encoding.build_vocab(df).collect()]
    assert Counter(tokens)["<pad>"] == 1 and "x" in tokens


@pytest.mark.parametrize("bound", [encoding.HEAD_ROWS, 7, 0])
def test_encode_both_ways(spark, docs, bound):
    vocab = encoding.build_vocab(docs, max_size=len(SPECIALS) + 3)
    rows = encoding.tokenize(docs).withColumn("more", F.array(F.lit("c"), F.lit("?")))
    out = encoding.encode(rows, vocab, {"tokens": "ids", "more": "more_ids"}, head_rows=bound)
    got = {r["example_id"]: (r["ids"], r["more_ids"]) for r in out.collect()}
    more = [7, UNK]
    assert got == {1: ([6, 5, 5, 7], more), 2: ([7, UNK, 6, 5], more), 3: ([], more), 4: ([UNK, 5], more), 5: (None, more)}


@pytest.mark.parametrize("bound", [encoding.HEAD_ROWS, 7, 0])
def test_decode_both_ways(spark, docs, bound):
    vocab = encoding.build_vocab(docs)
    ids = encoding.encode(encoding.tokenize(docs), vocab, {"tokens": "ids"})
    padded = ids.withColumn("ids", F.concat(F.col("ids"), arrays.ints([PAD, 999, UNK])))
    out = encoding.decode(padded, vocab, {"ids": "back"}, head_rows=bound)
    assert {r["example_id"]: r["back"] for r in out.collect()} == {1: "b a a c", 2: "c d b a", 3: "", 4: "zz a", 5: None}


@pytest.mark.parametrize("bound", [encoding.HEAD_ROWS, 7, 0])
def test_encode_rows_without_tokens(spark, bound):
    df = spark.createDataFrame([(1, []), (2, None)], "example_id bigint, tokens array<string>")
    vocab = spark.createDataFrame([("a", 5)], "token string, id int")
    out = encoding.decode(encoding.encode(df, vocab, {"tokens": "ids"}, head_rows=bound), vocab, {"ids": "text"})
    assert [(r["ids"], r["text"]) for r in out.orderBy("example_id").collect()] == [([], ""), (None, None)]


def test_a_text_is_looked_up_once_for_each_side_of_the_join(spark, docs):
    vocab = spark.createDataFrame([("a", 5), ("c", 6)], "token string, id int")
    out = encoding.encode(encoding.tokenize(docs), vocab, {"tokens": "ids"}, head_rows=6).select("example_id", "ids")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Both sides of the join, and the fill behind it; a filter on the lacking tokens would look up once more.
    assert plan.count("ArrowEvalPython [") == 3


def test_encode_by_join_with_repeated_rows_and_null_tokens(spark):
    rows = [(1, ["x", None, "y", "x"]), (1, ["x", None, "y", "x"]), (None, ["y", "x"]), (None, None), (2, ["a", "none"])]
    df = spark.createDataFrame(rows, "example_id bigint, tokens array<string>")
    vocab = spark.createDataFrame([("a", 5), ("x", 6), ("y", 7)], "token string, id int")
    out = encoding.encode(df, vocab, {"tokens": "ids"}, head_rows=6)
    want = [(1, [6, UNK, 7, 6]), (1, [6, UNK, 7, 6]), (None, [7, 6]), (None, None), (2, [5, UNK])]
    assert Counter((r["example_id"], str(r["ids"])) for r in out.collect()) == Counter((i, str(x)) for i, x in want)


def shuffled_records(plan):
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled_records(plan.children().apply(i)) for i in range(plan.children().size()))


def test_rows_of_a_chunk_ask_for_a_token_once(spark):
    """300 rows in two tasks have 40 of 60 words each. Some hundred records are shuffled, not one for each word of a row."""
    rows = [(i, [f"w{(i * i + (i % 7 + 1) * k) % 61}" for k in range(40)]) for i in range(300)]
    vocab = spark.createDataFrame([(f"w{k}", k + 5) for k in range(60)], "token string, id int")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "example_id bigint, tokens array<string>").coalesce(2)
        out = encoding.encode(df, vocab, {"tokens": "ids"}, head_rows=0).select("example_id", "ids")
        got = {r["example_id"]: r["ids"] for r in out.collect()}
        records = shuffled_records(out._jdf.queryExecution().executedPlan())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: [int(w[1:]) + 5 if w != "w60" else UNK for w in words] for i, words in rows}
    # The rows and their answers, the vocabulary, and what two tasks ask for.
    assert records < 300 + 300 + 60 + 2 * 100


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_chunks_of_any_size_give_equal_results(spark, monkeypatch, chunk):
    """Copies, rows longer than a chunk, null rows and elements, and batches of three rows."""
    monkeypatch.setattr(encoding, "CHUNK", chunk)
    monkeypatch.setattr(encoding, "GATHERED", 4)
    vocab = spark.createDataFrame([(f"w{k}", k + 5) for k in range(40)], "token string, id int")
    texts = [[f"w{(i * i + k) % 45}" for k in range(i % 12)] + [None] * (i % 3) for i in range(40)] + [None]
    rows = [(i % 50, texts[i % 41], texts[i * 7 % 41]) for i in range(80)]
    df = spark.createDataFrame(rows, "example_id bigint, a array<string>, b array<string>").coalesce(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        ids = encoding.encode(df, vocab, {"a": "x", "b": "y"}, head_rows=9)
        out = encoding.decode(ids, vocab, {"x": "back"}, head_rows=9).select("example_id", "x", "y", "back").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def known(words):
        return [w for w in words if w and int(w[1:]) < 40]

    def want(words):
        return words and [int(w[1:]) + 5 if w in known(words) else UNK for w in words]

    expected = Counter(str((i, want(a), want(b), a if a is None else " ".join(known(a)))) for i, a, b in rows)
    assert Counter(str(tuple(r)) for r in out) == expected


def test_packed_lists_of_numbers():
    lists = pa.array([[1, None, -7], None, [], [2**31 - 1, -(2**31)], [None]], pa.list_(pa.int32()))
    binary = packed(flat(lists), ends(lists), lists.is_null())
    for a, b in [(0, 5), (1, 4), (2, 3), (3, 5), (5, 5)]:
        some = binary[a:b]
        assert regroup(*unpacked(some), some.is_null()).to_pylist() == lists[a:b].to_pylist()


def test_encode_by_join_spreads_a_hot_token(spark):
    df = spark.range(50).select(
        F.col("id").alias("example_id"), F.array_repeat(F.lit("hot"), 40).alias("tokens")
    )
    vocab = spark.createDataFrame([("hot", 3)], "token string, id int")
    out = encoding.encode(df, vocab, {"tokens": "ids"}, head_rows=0)
    assert all(r["ids"] == [3] * 40 for r in out.collect())


def test_pair_cuts_equal_the_loop(spark):
    cases = [(la, lb, b) for la in range(14) for lb in range(14) for b in range(0, 28, 3)]
    df = spark.createDataFrame(cases, "la int, lb int, b int")
    by_budget = [
        df.where(F.col("b") == b).select("la", "lb", "b", arrays.pair_cuts(F.col("la"), F.col("lb"), b).alias("cut"))
        for b in sorted({c[2] for c in cases})
    ]
    for part in by_budget:
        for r in part.collect():
            assert (r["cut"]["a"], r["cut"]["b"]) == longest_first(r["la"], r["lb"], r["b"]), r


@pytest.mark.parametrize("la, lb, budget, want", [(5, 3, 6, (3, 3)), (3, 5, 6, (3, 3)), (4, 4, 5, (3, 2)), (2, 2, 9, (2, 2))])
def test_pair_cuts_by_example(spark, la, lb, budget, want):
    assert tuple(one(spark, arrays.pair_cuts(F.lit(la), F.lit(lb), budget))) == want


def test_padding_and_masks(spark):
    ids = arrays.ints([7, 8])
    assert one(spark, arrays.pad_to(ids, 4, 0)) == [7, 8, 0, 0]
    assert one(spark, arrays.pad_to(ids, 4, 0, "left")) == [0, 0, 7, 8]
    assert one(spark, arrays.attention_mask(F.lit(2), 4)) == [1, 1, 0, 0]
    assert one(spark, arrays.attention_mask(F.lit(2), 4, "left")) == [0, 0, 1, 1]
    with pytest.raises(ValueError, match="side"):
        arrays.pad_to(ids, 4, 0, "middle")


def test_label_masks(spark):
    ids = arrays.ints([7, 0, 8, 0])
    assert one(spark, arrays.mask_pad_labels(ids, 0)) == [7, -100, 8, -100]
    assert one(spark, arrays.unmask_labels(arrays.mask_pad_labels(ids, 0), 0)) == [7, 0, 8, 0]
    assert one(spark, arrays.mask_labels_by_mask(ids, arrays.ints([1, 1, 1, 0]))) == [7, 0, 8, -100]


def test_shift_targets(spark):
    assert one(spark, arrays.shift_targets(arrays.ints([5, 6, 7]))) == [6, 7, -100]
    assert one(spark, arrays.shift_targets(arrays.ints([5]))) == [-100]
    assert one(spark, arrays.shift_targets(arrays.ints([]))) == []


def test_last_real_index(spark):
    assert one(spark, arrays.last_real_index(arrays.ints([7, 8, 0, 0]), 0)) == 1
    assert one(spark, arrays.last_real_index(arrays.ints([0, 0]), 0)) == -1
    assert one(spark, arrays.last_real_index(arrays.ints([0, 7, 8]), 0, "left")) == 2
    assert one(spark, arrays.pick_at(arrays.ints([7, 8]), F.lit(-1))) is None


def test_special_tokens(spark):
    a, b = arrays.ints([11]), arrays.ints([12, 13])
    assert one(spark, arrays.add_special_tokens(a, 2, 4)) == [2, 11, 4]
    assert one(spark, arrays.add_pair_special_tokens(a, b, 2, 3, 4)) == [2, 11, 3, 12, 13, 4]
    assert one(spark, arrays.add_pair_special_tokens(a, b, 2, 3, 4, seps=2)) == [2, 11, 3, 3, 12, 13, 4]


def test_multi_hot(spark):
    assert one(spark, arrays.multi_hot(arrays.ints([1, 1, 9]), 3)) == [0.0, 1.0, 0.0]
    assert one(spark, arrays.multi_hot(arrays.ints([]), 3)) == [0.0, 0.0, 0.0]


def test_ensure_pad_token(spark):
    df = spark.createDataFrame([("a", None, 9), ("b", 0, 9)], "name string, pad_id int, eos_id int")
    assert [r["pad_id"] for r in encoding.ensure_pad_token(df).orderBy("name").collect()] == [9, 0]


def test_pad_to_longest(spark):
    df = spark.createDataFrame([(0, [5]), (0, [5, 6, 7]), (1, [])], "batch_id int, input_ids array<int>")
    rows = encoding.pad_to_longest(df, PAD, multiple=2).orderBy("batch_id", "attention_mask").collect()
    assert [(r["input_ids"], r["attention_mask"]) for r in rows] == [
        ([5, 0, 0, 0], [1, 0, 0, 0]), ([5, 6, 7, 0], [1, 1, 1, 0]), ([], []),
    ]


PAIRS = [(1, "t", "a b c d e", "a b"), (2, None, "c", "d d d"), (3, "t", "", "a"), (4, "t", "a", None)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "example_id bigint, title string, text string, summary string")


@pytest.fixture(scope="module")
def vocab(spark):
    rows = [*((s, i) for i, s in enumerate(SPECIALS)), ("a", 5), ("b", 6), ("c", 7), ("d", 8), ("t", 9), ("TL;DR", 10)]
    return spark.createDataFrame(rows, "token string, id int")


@pytest.mark.parametrize("bound", [encoding.HEAD_ROWS, 7, 0])
def test_clm_table(spark, pairs, vocab, bound, monkeypatch):
    monkeypatch.setattr(encoding.encode, "__defaults__", (*encoding.encode.__defaults__[:-1], bound))
    rows = builders.build_clm_table(pairs, vocab, 6, 3).orderBy("example_id").collect()
    assert [r["example_id"] for r in rows] == [1, 2]
    assert rows[0]["input_ids"] == [9, 5, 6, 7, 8, 10, 5, 6, 0]
    assert rows[0]["attention_mask"] == [1, 1, 1, 1, 1, 1, 1, 1, 0]
    assert rows[1]["input_ids"] == [0, 0, 0, 0, 7, 10, 8, 8, 8]
    assert rows[1]["attention_mask"] == [0, 0, 0, 0, 1, 1, 1, 1, 1]
    assert all(r["labels"] == r["input_ids"] for r in rows)


def test_clm_table_masks(pairs, vocab):
    rows = builders.build_clm_table(pairs, vocab, 6, 3, mask_pad=True).orderBy("example_id").collect()
    assert rows[0]["labels"] == [9, 5, 6, 7, 8, 10, 5, 6, -100]
    rows = builders.build_clm_table(pairs, vocab, 6, 3, mask_pad=True, mask_prompt=True).orderBy("example_id").collect()
    assert rows[0]["labels"] == [-100] * 6 + [5, 6, -100]


def test_clm_rows_have_one_length(pairs, vocab):
    rows = builders.build_clm_table(pairs, vocab).collect()
    assert {len(r["input_ids"]) for r in rows} == {8064} and {len(r["attention_mask"]) for r in rows} == {8064}


def test_seq2seq_table(pairs, vocab):
    rows = builders.build_seq2seq_table(pairs, vocab).orderBy("example_id").collect()
    assert rows[0]["input_ids"] == [5, 6, 7, 8, UNK, 10] and rows[0]["labels"] == [5, 6]
    assert rows[1]["attention_mask"] == [1, 1]


@pytest.mark.parametrize("mask_by", ["value", "mask"])
def test_seq2seq_table_padded(pairs, vocab, mask_by):
    df = pairs.withColumn("batch_id", F.lit(0))
    rows = builders.build_seq2seq_table(df, vocab, batch="batch_id", multiple=8, mask_by=mask_by).orderBy("example_id").collect()
    assert rows[0]["input_ids"] == [5, 6, 7, 8, UNK, 10, 0, 0] and rows[0]["labels"] == [5, 6] + [-100] * 6
    assert rows[1]["attention_mask"] == [1, 1, 0, 0, 0, 0, 0, 0]


def test_seq2seq_mask_keeps_a_real_pad_id(spark, vocab):
    df = spark.createDataFrame([(1, "t", "a", "a <pad>")], "example_id bigint, title string, text string, summary string")
    by_value = builders.build_seq2seq_table(df, vocab).first()["labels"]
    by_mask = builders.build_seq2seq_table(df, vocab, mask_by="mask").first()["labels"]
    assert (by_value, by_mask) == ([5, -100], [5, 0])


def test_classification_tables(spark, vocab):
    df = spark.createDataFrame([(1, "a b c d", [1, 7, 9]), (2, "a", [])], "example_id bigint, text string, labels array<int>")
    rows = builders.build_classification_table(df, vocab, "unfair_tos", 4).orderBy("example_id").collect()
    assert rows[0]["input_ids"] == [2, 5, 6, 4] and rows[1]["input_ids"] == [2, 5, 4, 0]
    assert rows[0]["labels"] == [0, 1, 0, 0, 0, 0, 0, 1] and sum(rows[1]["labels"]) == 0
    assert dict(builders.build_classification_table(df, vocab, "unfair_tos", 4).dtypes)["labels"] == "array<float>"


def test_build_features_dispatches(spark, pairs, vocab):
    assert set(builders.build_features(pairs, vocab, "billsum").columns) == {"example_id", "input_ids", "attention_mask", "labels"}
    with pytest.raises(ValueError, match="must be one of"):
        builders.build_features(pairs, vocab, "nothing")


def test_labels_are_masked_only_behind_an_ignored_prompt(spark):
    df = spark.createDataFrame([(1, "t", "a b", "c d")], "example_id bigint, title string, text string, summary string")
    vocab = encoding.load_codec(encoding.build_vocab(df, ["title", "text", "summary"]))
    out = builders.build_clm_table(df, vocab, 6, 3, mask_pad=True, mask_prompt=True)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "zip_with(slice(" in plan
    row = out.first()
    assert row["labels"] == [-100] * 6 + row["input_ids"][6:8] + [-100] and row["attention_mask"][6:] == [1, 1, 0]


def test_head_finds_tokens_by_hash_and_bytes(monkeypatch):
    """As a plain look-up does; the table is not built anew for each batch, and equal hashes do not mix tokens up."""
    tokens = ["a", "", "b", "a", "été", "日本", "x" * 64, "ab", "ba", "c\0", "c"]
    entries = pa.RecordBatch.from_pydict({"token": pa.array(tokens), "id": pa.array(range(len(tokens)), pa.int32())})
    asked = ["ba", "a", "zz", "", "x" * 64, "x" * 65, "x" * 63, "c", "c\0", "日本", "q" * 9000]
    want = [max((i for i, t in enumerate(tokens) if t == a), default=-1) for a in asked]
    with monkeypatch.context() as patched:
        patched.setattr(encoding.pc, "index_in", None)
        head = encoding.Head(entries)
        assert head.find("encode", pa.array(asked)).tolist() == want
        assert head.find("encode", pa.array(["no", *asked, "no"])[1:-1]).tolist() == want
        assert encoding.Head(entries.slice(0, 0)).find("encode", pa.array(asked)).tolist() == [-1] * len(asked)
        assert head.find("encode", pa.array([], pa.string())).tolist() == []
    monkeypatch.setattr(encoding, "string_hashes", lambda strings, longest: np.zeros(len(strings), np.uint64))
    assert encoding.Head(entries).find("encode", pa.array(asked)).tolist() == want
