"""Packing against the tokenizers library and a plain round-robin."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from sheafwork.llm import mixed_packing as mp
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, **options):
    """Every token once and in its place, sequences without gaps and of full length or a power of two."""
    size = options.get("sequence", mp.SEQUENCE)
    got = mp.packed(docs, PATH, **options).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        wanted[r["doc_id"]].append(ids_of(r["text"]))
    assert set(by_doc) == set(wanted)
    for i, rows in by_doc.items():
        if len(wanted[i]) == 1:
            rows.sort(key=lambda r: r["start"])
            assert [r["start"] for r in rows] == list(np.cumsum([0, *(r["length"] for r in rows[:-1])]))
            assert np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist() == wanted[i][0]
            assert {r["doc_tokens"] for r in rows} == {len(wanted[i][0])}
        else:
            assert sum(r["length"] for r in rows) == sum(map(len, wanted[i]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts[:-1])]))
        total = sum(n for _, n in parts)
        assert total == size or (total < size and total & (total - 1) == 0)
    return got


def test_odd_rows(spark, odd, none):
    check(odd)
    check(odd, sequence=64, window=2)
    assert mp.packed(none, PATH).count() == 0
    assert mp.packed(odd.withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)), PATH).count() == mp.packed(odd, PATH).count()


def mixed(spark, seed=2, n=700):
    random.seed(seed)
    vocabulary = ["sun", "Tree.", "river", "don't", "stone,", "x1y", "é", "road!"]
    rows = []
    for i in range(n):
        source = random.choices(["a", "b", "c", None], [6, 2, 1, 1])[0]
        length = random.choice([3, 20, 60, 300]) if i % 50 else 4000
        rows.append((i, source, " ".join(random.choice(vocabulary) for _ in range(length))))
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 5, "c": 2, None: 2}])
def test_windows_hold_the_target_proportions(spark, weights):
    """The account of every window equals a round-robin that goes window by window and carries the deficits."""
    docs = mixed(spark)
    size, window = 128, 8
    got = check(docs, sequence=size, window=window, weights=weights)
    sent = collections.Counter()
    for r in got:
        sent[r["window"], r["source"]] += r["length"]
    queues = collections.defaultdict(list)
    totals = collections.Counter()
    for r in got:
        totals[r["source"]] += r["length"]
    import hashlib

    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        left = len(ids_of(r["text"]))
        while left:
            queues[r["source"]].append(min(left, size))
            left -= queues[r["source"]][-1]
    share = {s: (weights[s] if weights else totals[s]) for s in totals}
    granted, served = dict.fromkeys(totals, 0.0), dict.fromkeys(totals, 0)
    plain, turn = collections.Counter(), 0
    while any(queues.values()):
        room = size * window
        # What a dry queue has no use for goes to the others.
        while room > 1e-9 and any(granted[s] < totals[s] - 1e-9 for s in totals):
            open_ = [s for s in totals if granted[s] < totals[s] - 1e-9]
            part = min(min((totals[s] - granted[s]) / share[s] for s in open_), room / sum(share[s] for s in open_))
            for s in open_:
                granted[s] += part * share[s]
            room -= part * sum(share[s] for s in open_)
        for s, queue in queues.items():
            while queue and served[s] + queue[0] <= granted[s] + 1e-6:
                served[s] += queue[0]
                plain[turn, s] += queue.pop(0)
        turn += 1
        assert all(0 <= granted[s] - served[s] + 1e-6 < size + 1e-5 for s in totals)
    assert sent == plain


def test_weights_are_checked(spark):
    docs = mixed(spark, n=20)
    with pytest.raises(ValueError):
        mp.packed(docs, PATH, weights={"a": 1})
    with pytest.raises(ValueError):
        mp.packed(docs, PATH, weights={str(i): 1 for i in range(300)})
    with pytest.raises(ValueError):
        mp.packed(docs, PATH, sequence=100)


def test_reruns_agree(spark):
    docs = mixed(spark, n=200)
    one, two = (sorted(map(tuple, mp.packed(d, PATH).collect()), key=repr) for d in (docs, docs.repartition(5)))
    assert one == two


def test_tail_is_cut_into_powers_of_two():
    for total in (0, 1, 2047, 2048, 2049, 4095, 5000):
        parts = mp.tail(total)
        assert sum(n for _, n in parts) == total % 2048 and all(n & (n - 1) == 0 for _, n in parts)
        line = mp.Line(total)
        if total:
            got = line.pieces([(0, total, 0, 0)])
            assert sum(x[1] for x in got) == total


def test_encoder_equals_the_library():
    encoder = mp.Encoder(open(PATH, "rb").read())
    random.seed(6)
    letters = "İĲŉǅÀ#&abcdeghinorst ABΣσİßéñ\n\t'0192!?.<|>/😀́​\x1c\x85\xa0Ж中J̌"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["a <|startoftext|>b<|endoftext|> c", "don't Can't, x''s it's!!", "Word,word. Word!"]
    ids, at = encoder.ids(pa.array(texts))
    for text, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == ids_of(text), text


def test_very_long_texts_are_cut_at_blanks():
    for text in ("one two\n" * 50, "x" * 300, "x" * 90 + " y" * 40, " " * 77 + "\n\n"):
        parts = mp._long_parts(text, 20)
        assert [i for p in parts for i in ids_of(p)[:-1]] == ids_of(text)[:-1]
