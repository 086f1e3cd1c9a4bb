"""The trained models held against plain Python: features, gradients, thresholds, forward passes, weighted sets."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sheafwork.llm import conv, near_dedup, ranking

TEXTS = ["", None, "one", "One two, two! three?\n\nfour four five", "é😀 Σ 12 (x) #tag | a/b " * 7, "w w w w", "  \t\n ", "x" * 300]


def naive_features(text):
    raw = (text or "").encode()
    pairs = np.zeros((ranking.KINDS, ranking.KINDS))
    for a, b in zip(raw, raw[1:]):
        pairs[ranking.KIND[a], ranking.KIND[b]] += 1
    words, word = [], b""
    for byte in [*raw, 32]:
        if byte == 32 or 9 <= byte <= 13:
            words, word = (words + [word] if word else words), b""
        else:
            word += bytes([byte])
    n = max(len(words), 1)
    tail = [sum(a == b for a, b in zip(words, words[k:])) / n for k in (1, 2)]
    tail += [len(set(words)) / n, math.log1p(len(raw) / n), math.log1p(len(words)) / 10, math.log1p(len(raw)) / 10]
    return [*np.sqrt(pairs.ravel() / max(len(raw) - 1, 1)), *tail]


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_features_equal_plain_python(monkeypatch, block):
    monkeypatch.setattr(ranking, "BLOCK", block)
    got = ranking.features(pa.array(TEXTS))
    for row, text in zip(got, TEXTS):
        assert row == pytest.approx(naive_features(text), abs=1e-12)


def test_pairs_are_fitted_to_the_least_loss():
    """Newton steps on the same loss end at the same weights."""
    random = np.random.default_rng(3)
    better, worse = random.normal(0.3, 1, (200, 5)), random.normal(-0.3, 1, (200, 5))
    d, penalty = better - worse, 1e-2
    w = np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(d @ w))
        grad = penalty * w - d.T @ p / len(d)
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(5), grad)
    assert ranking.fit_pairs(better, worse, penalty, 3000) == pytest.approx(w, abs=1e-5)


def ranker_of(aside, labels):
    made = ranking.Ranker(np.zeros(1), np.ones(1), np.ones(1))
    made.aside_worth, made.aside_label = np.array(aside, float), np.array(labels)
    return made


@pytest.mark.parametrize("seed", range(4))
def test_threshold_is_the_best_quantile_of_all_rows(spark, seed):
    """The balanced accuracy on rows kept aside is the best of all cells' bounds, and the quantile is the share below it."""
    random.seed(seed)
    aside = [(random.gauss(c, 0.8), c) for c in [0, 1] * 60]
    made = ranker_of(*zip(*aside))
    corpus = [random.gauss(random.random() < 0.8, 0.8) for _ in range(3000)] + [-50.0, 50.0]
    got = ranking.cut_at_quantile(spark.createDataFrame([(w,) for w in corpus], "worth double"), made)

    def right(cut):
        return sum((w >= cut) == c for w, c in aside) / 60

    assert right(got.threshold) == pytest.approx(max(map(right, ranking.cell_edges(made))))
    assert got.quantile == pytest.approx(sum(w < got.threshold for w in corpus) / len(corpus), abs=2 / len(corpus))


def test_a_gap_of_the_labelled_rows_is_cut_by_all_rows(spark):
    """No labelled row lies between 0 and 1; unlabelled ones do, so the cut is at the middle of their quantiles."""
    made = ranker_of([-1, 0, 1, 2], [0, 0, 1, 1])
    corpus = [-1.0] * 40 + [0.9 + i / 10000 for i in range(20)] + [2.0] * 40
    got = ranking.cut_at_quantile(spark.createDataFrame([(w,) for w in corpus], "worth double"), made)
    assert got.quantile == pytest.approx(0.5, abs=0.05) and 0.9 <= got.threshold <= 0.902
    none = spark.createDataFrame([], "worth double")
    assert ranking.cut_at_quantile(none, made) is made
    # With nothing between, the cut is in the middle of the gap.
    apart = ranking.cut_at_quantile(spark.createDataFrame([(-1.0,), (2.0,)], "worth double"), made)
    assert apart.threshold == pytest.approx(0.5, abs=0.01) and apart.quantile == 0.5


def test_ties_and_repeated_rows_have_equal_scores(spark):
    docs = spark.createDataFrame([(i % 20, TEXTS[i % 8], "own", i) for i in range(80)], "doc_id long, text string, score string, worth long")
    made = ranker_of([0, 0, 1, 1], [0, 0, 1, 1])
    made.mean, made.spread, made.weights = np.zeros(ranking.FEATURES), np.ones(ranking.FEATURES), np.linspace(-1, 1, ranking.FEATURES)
    rows = ranking.scored(docs, made, out="made").collect()
    assert len(rows) == 80 and sorted(r["worth"] for r in rows) == list(range(80)) and {r["score"] for r in rows} == {"own"}
    by = collections.defaultdict(set)
    for r in rows:
        by[r["text"] or ""].add(r["made"])
    assert all(len(found) == 1 for found in by.values())
    want = {t or "": made.score(ranking.features(pa.array([t])))[0] for t in TEXTS}
    assert all(found.pop() == pytest.approx(want[t], abs=1e-7) for t, found in by.items())


def small_network(seed=5):
    net = conv.Network.new(seed)
    net.table, net.out = net.table.astype(float), net.out.astype(float)
    net.filters = [f.astype(float) for f in net.filters]
    net.biases = [np.random.default_rng(seed).normal(0, 0.1, conv.FILTERS) for _ in conv.WIDTHS]
    return net


def naive_pooled(net, text, words):
    """Every filter at every place of one text between pads, the largest answer, 0 at least."""
    pad = np.zeros(conv.DIM)
    inside = [np.mean([net.table[p] for p in words[n]], axis=0) for n in text]
    line = [pad] * max(conv.WIDTHS) + inside + [pad] * max(conv.WIDTHS)
    best = []
    for k, w in enumerate(conv.WIDTHS):
        for f in range(conv.FILTERS):
            answers = [sum(line[at + j] @ net.filters[k][j, :, f] for j in range(w)) for at in range(len(line) - w + 1)]
            best.append(max(0.0, max(answers) + net.biases[k][f]))
    return np.array(best)


LINES = ["red green blue", "", "blue", "vile words and green things in a row", "red red", "green"]


def test_forward_pass_equals_a_plain_convolution():
    """Also: a text's score does not hang on the texts that stand beside it."""
    net, words = small_network(), conv.Words()
    texts = [words.of(t) for t in LINES]
    table = words.table()
    want = [naive_pooled(net, t, table) @ net.out + net.bias for t in texts]
    assert net.logits(texts, table) == pytest.approx(want, abs=1e-5)
    for t, w in zip(texts, want):
        assert net.logits([t], table)[0] == pytest.approx(w, abs=1e-5)


def test_gradients_equal_numeric_ones():
    net, words = small_network(9), conv.Words()
    texts = [words.of(t) for t in LINES]
    table = words.table()
    want, weight = np.array([0, 1, 0, 1, 0, 1.0]), np.array([1, 2, 1, 1, 3, 1.0])

    def loss():
        z = np.array([naive_pooled(net, t, table) @ net.out + net.bias for t in texts])
        return (weight * (np.logaddexp(0, z) - want * z)).sum() / weight.sum()

    places = [(net.out, i) for i in range(0, 36, 5)]
    places += [(net.biases[k], f) for k in range(3) for f in (0, 7)]
    places += [(net.filters[k], (j, 3, f)) for k in range(3) for j in range(k + 1) for f in (1, 8)]
    places += [(net.table, (int(table[n][p]), 2)) for n in (1, 4) for p in (0, 5)]
    numeric, eps = [], 1e-5
    for array, at in places:
        array[at] += eps
        up = loss()
        array[at] -= 2 * eps
        numeric.append((up - loss()) / (2 * eps))
        array[at] += eps
    before = [array[at] for array, at in places]
    # A first step of Adagrad is rate * grad / sqrt(1e-6 + grad ** 2), which gives the gradient back.
    conv._step(net, texts, table, want, weight, {}, 1e-3)
    moved = np.array([b - array[at] for (array, at), b in zip(places, before)]) / 1e-3
    got = moved * 1e-3 / np.sqrt(np.maximum(1 - moved**2, 1e-12))
    for g, n in zip(got, numeric):
        if abs(n) < 0.01:  # beyond that the step is nearly 1 whatever the gradient
            assert g == pytest.approx(n, abs=1e-4, rel=0.05)
        else:
            assert np.sign(g) == np.sign(n) and abs(g) > 0.005


def test_a_language_without_calibration_is_cut_at_one_half(spark):
    net = conv.Network.new(3)
    net.thresholds = {"en": 0.3}
    rows = spark.createDataFrame([("en",), ("xx",), (None,)], "lang string").select("lang", conv.threshold_of(net, F.col("lang")).alias("t")).collect()
    assert {r["lang"]: r["t"] for r in rows} == {"en": 0.3, "xx": 0.5, None: 0.5}


def weighted(text):
    words = text.lower().split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_repeated_shingles_weigh_as_often_as_they_occur(spark):
    """Links by weighted similarity over all pairs; as plain sets many of these texts would be equal."""
    random.seed(12)
    lines = [" ".join(f"{c}{i}" for i in range(8)) for c in "abcdef"]
    texts = [" ".join(random.choice(lines[k % 2 :: 2]) for _ in range(random.choice([4, 5, 20, 21, 22]))) for k in range(60)]
    texts += [" ".join([lines[0]] * n + [lines[1]] * 2) for n in (3, 4, 30, 33, 36, 60)]
    sets = [weighted(t) for t in texts]
    label = list(range(len(texts)))
    pairs = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            pairs += 1
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    plain = sum(len(sets[a].keys() & sets[b].keys()) >= 0.8 * len(sets[a].keys() | sets[b].keys()) for a, b in itertools.combinations(range(len(texts)), 2))
    assert 0 < pairs < plain
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == dict(enumerate(label))


def test_signatures_of_occurrences_recall_nearly_all_links():
    """Pairs of weighted similarity 0.8 to 0.85 share a band in at least nine of ten cases."""
    random.seed(4)
    met = total = 0
    while total < 60:
        base = [random.choice(["p q r s t u v w", "k l m n o", "x y z"]) + f" {random.randint(0, 40)}" for _ in range(40)]
        other = [part if random.random() > 0.05 else f"new{random.random()}" for part in base]
        texts = [" ".join(base), " ".join(other)]
        if not 0.8 <= similarity(*map(weighted, texts)) <= 0.85:
            continue
        value, times, before = near_dedup.shingles(pa.array(texts))
        assert times.max() > 1
        keys = near_dedup.band_keys(near_dedup.signatures(value, times.astype(float), before, near_dedup.BANDS * near_dedup.ROWS), near_dedup.BANDS, near_dedup.ROWS)
        total += 1
        met += bool((keys[0] == keys[1]).any())
    assert met >= 0.9 * total


@pytest.mark.parametrize("name", ["_gone", "class_id", "id", "a", "label"])
def test_near_copies_keep_columns_with_the_names_of_helpers(spark, name):
    rows = [(i, "the same few words stand here " * 3, i) for i in range(4)] + [(9, None, 9)]
    left = near_dedup.one_of_each(spark.createDataFrame(rows, f"doc_id long, text string, {name} long"))
    assert left.columns == ["doc_id", "text", name] and sorted(map(tuple, left.collect())) == sorted([rows[0], rows[4]])


def test_training_takes_rows_beyond_the_first_sample(spark, monkeypatch):
    """One mark of class 1 stands in texts too long for the start only; several tasks, and reruns agree."""
    random.seed(15)
    clean = [" ".join(random.choice(["sun", "tree", "river", "stone"]) for _ in range(random.choice([20, 60]))) for _ in range(600)]
    rows = []
    for i, text in enumerate(clean):
        mark = {0: "vile", 1: "foul"}.get(i % 4)
        text += f" {mark}" if mark else ""
        rows.append((i, text * 3 if mark == "foul" and i < 500 else text, "en", int(mark is not None)))
    docs = spark.createDataFrame([(i, t + " " * 500 if "foul" in t and i < 500 else t, lang, y) for i, t, lang, y in rows], "doc_id long, text string, lang string, label int")
    monkeypatch.setattr(conv, "TASK_ROWS", 200)
    nets = [conv.learn(docs, docs.where("doc_id < 500").select("doc_id", "label"), rows=60, max_bytes=500) for _ in range(2)]
    got = conv.scored(docs.where("doc_id >= 500"), nets[0]).collect()
    hit = [(r["score"] >= 0.5) == bool(r["label"]) for r in got if "foul" in r["text"]]
    assert len(hit) == 25 and np.mean(hit) > 0.9
    assert np.mean([(r["score"] >= 0.5) == bool(r["label"]) for r in got]) > 0.9
    assert (nets[0].table == nets[1].table).all() and nets[0].scale == nets[1].scale and nets[0].thresholds == nets[1].thresholds
    assert nets[0].thresholds.keys() == {"en"}


def test_parameters_travel_whole():
    net = conv.Network.new(4)
    net.bias = 0.25
    again = conv._with_parameters(net, conv._parameters(net))
    assert (again.table == net.table).all() and (again.out == net.out).all() and again.bias == 0.25
    assert all((a == b).all() for a, b in zip([*again.filters, *again.biases], [*net.filters, *net.biases]))


def test_long_texts_train_in_blocks(monkeypatch):
    """A step over blocks moves the parameters as one over whole texts."""
    words, moved = conv.Words(), []
    texts = [words.of(t) for t in ("a b c d e f g " * 40, "", "h i", "a " * 300)]
    for block in (conv.BLOCK, 7):
        monkeypatch.setattr(conv, "BLOCK", block)
        net = conv.Network.new(2)
        conv._step(net, texts, words.table(), np.array([1, 0, 0, 1]), np.ones(4), {}, 0.05)
        moved.append(conv._parameters(net))
    assert moved[0] == pytest.approx(moved[1], abs=1e-5)


def test_best_threshold_counts_rows():
    score, want, times = np.array([0.1, 0.6, 0.6, 0.9]), np.array([0, 0, 1, 1]), np.array([5, 95, 1, 3])
    plain = np.repeat(score, times), np.repeat(want, times)
    cuts = [0.35, 0.5, 0.75]
    hit = [(plain[0][plain[1] > 0] >= c).mean() + (plain[0][plain[1] == 0] < c).mean() for c in cuts]
    assert conv.best_threshold(score, want, times) == pytest.approx(cuts[int(np.argmax(hit))])


def test_words_keep_their_rows():
    for stretch in ("Word.", "a,b!", "été?", "...", "x", "日本語。", "İ9", "don't", "ab" * 40):
        word = conv._NOT_LETTERS.sub("", stretch).lower()
        parts = ("w" + word, *(f"{n}{word[:n]}" for n in (3, 4, 5, 6)), "e" + word[-3:])
        assert conv.letters_of(stretch) == word
        assert conv.rows_of([conv.hashes_of(word)]).tolist() == [[1 + zlib.crc32(p.encode()) % (conv.TABLE - 1) for p in parts]]
