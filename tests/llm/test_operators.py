"""The corpus operators on odd rows, on empty tables, and against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from sheafwork.llm import bpe, conv, exact_dedup, merkle, mixing, near_dedup, ranking, repeats, revisits, url_model
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_exact_odd_rows(odd, none):
    got = exact_dedup.duplicates(odd).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[1] == [(1, 3, True)] and by[2] == [(1, 3, False)] and by[None] == [(1, 3, False)]
    assert by[3] == [(3, 2, True)] and by[4] == [(3, 2, False)] and by[5] == [(5, 1, True)]
    assert sorted(by[7]) == [(7, 2, False), (7, 2, True)]
    assert exact_dedup.duplicates(none).count() == 0
    left = exact_dedup.drop_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 5, 6, 7, 8]


@pytest.mark.parametrize("size", [1, 3, 64])
def test_exact_names_do_not_rest_on_the_hash(spark, size):
    random.seed(size)
    texts = ["".join(random.choice("ab") for _ in range(random.randint(0, 9))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact_dedup.duplicates(docs, block_bytes=size, hashed=lambda b: F.length(b) % 2).collect()
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert {r["doc_id"]: r["keep_id"] for r in got} == {i: first[t] for i, t in enumerate(texts)}


def test_merkle_odd_rows(odd, none):
    got = merkle.fingerprints(odd).collect()
    assert len(got) == len(odd.collect()) and merkle.fingerprints(none).count() == 0
    prints = collections.defaultdict(set)
    for r in got:
        prints[r["doc_id"]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[1] == prints[None] != prints[2] and prints[3] == prints[4] != prints[5] and len(prints[7]) == 1


def _tree(text):
    """Leaves by section and paragraph, as texts."""
    pattern = re.compile(merkle.LEAF)
    return [[[m.group() for m in pattern.finditer(p)] for p in s.split("\n")] for s in text.split("\n\n")]


def _edits(a, b, path_a=(), path_b=(), level=0):
    """By counting: the n-th copy meets the n-th, what is left over is paired in order."""
    names = ("section", "paragraph", "leaf")
    left, matched = collections.defaultdict(list), []
    for j, node in enumerate(b):
        left[repr(node)].append(j)
    lone_a = []
    for i, node in enumerate(a):
        if left[repr(node)]:
            matched.append((i, left[repr(node)].pop(0)))
        else:
            lone_a.append(i)
    lone_b = sorted(j for js in left.values() for j in js)
    rank = {j: r for r, j in enumerate(sorted(j for _, j in matched))}
    out = [(names[level], "moved", (*path_a, i), (*path_b, j)) for r, (i, j) in enumerate(matched) if rank[j] != r]
    for i, j in itertools.zip_longest(lone_a, lone_b):
        at_a, at_b = None if i is None else (*path_a, i), None if j is None else (*path_b, j)
        if i is not None and j is not None and level < 2:
            out += _edits(a[i], b[j], at_a, at_b, level + 1)
        else:
            out.append((names[level], "removed" if j is None else "inserted" if i is None else "changed", at_a, at_b))
    return out


def _first(a, b):
    places = []
    for _ in range(3):
        at = -1 if a is None or b is None else next((i for i, (x, y) in enumerate(itertools.zip_longest(a, b)) if x != y), -1)
        places.append(at)
        a = a[at] if a is not None and 0 <= at < len(a) else None
        b = b[at] if b is not None and 0 <= at < len(b) else None
    return None if places[0] < 0 else tuple(places)


def test_merkle_edits_are_located(spark):
    random.seed(11)
    words = ["one ", "two ", "three. ", "four", "\n", "\n\n", "five six seven eight nine ten eleven twelve "]
    pairs = [
        ("one two.\nthree four.\n\nfive six.", "one two.\nthree 4.\n\nfive six."),
        ("a\nb\n\nc", "a\nnew\nb\n\nc"),
        ("a\nb\n\nc", "b\na\n\nc"),
        ("a\n\nb\n\nb", "b\n\na"),
        ("same", "same"),
        ("", "x"),
        (None, ""),
        ("x. x. x.", "x. x."),
    ]
    for _ in range(150):
        text = [random.choice(words) for _ in range(random.randint(0, 14))]
        other = list(text)
        for _ in range(random.randint(0, 3)):
            at = random.randint(0, len(other))
            other[at : at + random.randint(0, 2)] = random.choices(words, k=random.randint(0, 2))
        pairs.append(("".join(text), "".join(other)))
    rows = spark.createDataFrame([(i, a, b, 0) for i, (a, b) in enumerate(pairs)], "doc_id long, before string, after string, level int")
    got = collections.defaultdict(list)
    for r in merkle.edits(rows).collect():
        sides = [None if p is None else tuple(p) for p in (r["place_before"], r["place_after"])]
        got[r["doc_id"]].append((r["level"], r["kind"], *sides))
    trees = [(_tree(a or ""), _tree(b or "")) for a, b in pairs]
    for i, (a, b) in enumerate(trees):
        assert sorted(got[i], key=repr) == sorted(_edits(a, b), key=repr) and bool(got[i]) == (a != b)
    assert got[1] == [("paragraph", "inserted", None, (0, 1))] and {k for _, k, *_ in got[2]} == {"moved"}
    first = rows.select("doc_id", merkle.first_edit(merkle.leaf_digests(F.col("before")), merkle.leaf_digests(F.col("after"))).alias("e"))
    assert {r["doc_id"]: r["e"] and tuple(r["e"]) for r in first.collect()} == {i: _first(a, b) for i, (a, b) in enumerate(trees)}


def test_bpe_equals_the_library(odd, none):
    library = Tokenizer.from_file(PATH)
    got = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert sorted(got, key=repr) == sorted(bpe.round_trip(odd, PATH).collect(), key=repr)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(none, PATH).count() == 0


def test_bpe_fuzz():
    library, own = Tokenizer.from_file(PATH), bpe.vocabulary(open(PATH, "rb").read())
    random.seed(5)
    letters = "abcdeghinorst ABΣσİßéñ\n\t'0192!?.<|>/😀́​\x1c\x85\xa0Ж中"
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_mix_meets_targets(spark, none):
    random.seed(4)
    rows = [(i, "w " * random.randint(0, 60), random.choice(["a", "b", "c", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).join(docs, "doc_id").collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.copies(docs).collect()}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r["size"] == len(r["text"].split()) and 0 <= r["copies"] <= 2 and r["taken"] == r["size"] * r["copies"] == again[r["doc_id"]]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    total, weights, open_ = 1.5 * sum(sizes.values()), {"a": 5, "b": 2, "c": 1, None: 5}, set(sizes)
    want = {}
    while True:
        level = (total - sum(want.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        want |= {s: 2 * sizes[s] for s in over}
        open_ -= over
        if not over:
            break
    want |= {s: weights[s] * level for s in open_}
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(target[s], rel=0.02)
    assert mixing.mixed(docs.withColumn("size", F.lit("clash"))).count() == sum(r["copies"] for r in got)
    assert mixing.copies(none).count() == 0


def test_mix_odd_rows(odd):
    got = mixing.copies(odd).collect()
    assert len(got) == 10 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed(odd).columns == odd.columns


def test_near_copies_equal_brute_force(spark, odd, none):
    random.seed(8)
    base = [[f"w{random.randint(0, 3000)}" for _ in range(80)] for _ in range(12)]
    texts = []
    for i in range(150):
        words = list(random.choice(base))
        for _ in range(random.randint(0, 5)):
            words[random.randrange(80)] = f"e{random.randint(0, 99)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(zip(*(t.split()[j:] for j in range(5)))) for t in texts]
    label = list(range(150))
    for a, b in itertools.combinations(range(150), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == dict(enumerate(label))
    found = near_dedup.classes(odd).collect()
    assert len(found) == 10 and {r["class_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert near_dedup.classes(none).count() == 0
    assert near_dedup.one_of_each(odd).columns == odd.columns


def test_darts_estimate_weighted_similarity():
    value = np.arange(1, 401, dtype=np.uint64)
    a, b = np.where(value % 3, 1.0, 4.0), np.where(value % 5, 1.0, 3.0)
    entries = near_dedup.signatures(np.concatenate((value, value)), np.concatenate((a, b)), np.array([0, 400, 800]), 2000)
    assert (entries[0] == entries[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def brute_repeats(rows, length):
    first, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        for j in range(len(raw) - length + 1):
            first.setdefault(raw[j : j + length], i)
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - length + 1):
            if first[raw[j : j + length]] < i:
                gone[j : j + length] = True
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("hot", [1, 64])
def test_repeats_equal_brute_force(spark, hot):
    random.seed(hot)
    shared = ["".join(random.choice("abc ") for _ in range(random.randint(20, 90))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [random.choice([*shared, "".join(random.choice("ab") for _ in range(30)), ""]) for _ in range(5)]
        rows.append((i, None if i == 9 else "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length, gram in ((50, 28), (24, 9)):
        got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(docs, length=length, gram=gram, hot=hot, block_bytes=2000).collect()}
        assert got == brute_repeats(rows, length)


def test_a_hot_anchor_is_not_sent_window_by_window():
    random.seed(5)
    text = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    shared = text(600)
    blocks = [pa.table({"block": [b], "id": [b], "text": [text(200) + shared + text(200)]}) for b in range(3)]
    told = repeats.answer(pa.concat_tables([repeats.ask(t, 1, 50, 28) for t in blocks]), hot=1)
    asked = [t.filter(pc.equal(t.column("block"), b)) for b, t in enumerate([told] * 3)]
    sent = pa.concat_tables([repeats.send(t, r, 1, 50, 28) for t, r in zip(blocks, asked)])
    entries = sum(r["n"] for r in sent.to_pylist() if r["kind"] == 0)
    assert 0 < entries < 3 * (600 - 50 + 1) / 2
    spans = [r for r in repeats.settle(sent, 50, 28).to_pylist() if r["block"] > 0]
    for b, t in enumerate(blocks[1:], 1):
        own = pa.Table.from_pylist([r for r in spans if r["block"] == b])
        assert repeats.finish(t, own).column("spans").to_pylist() == [[{"start": 200, "end": 800}]]


def test_repeats_odd_rows(odd, none):
    got = repeats.without_repeats(odd).collect()
    assert len(got) == 10 and repeats.without_repeats(none).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(odd, id_col="lang")
    assert [r["n_bytes"] for r in got if r["doc_id"] == 4] == [0]
    assert all(r["spans"] == [] for r in got if r["doc_id"] in (6, 7))  # a document doesn't remove from itself


def test_interval_tree():
    words = sorted([b"banana", b"bandana", b"ban", b"can"])
    tree = repeats.intervals([repeats.common(a, b) for a, b in itertools.pairwise(words)])
    assert sorted(tree) == [(3, 0, 2)]
    members = [(b"xy", b"abcde"), (b"xy", b"abcdf"), (b"xz", b"abcde")]
    assert sorted(repeats.maximal_repeats(members, 5)) == [(1, 4, [0, 1, 2]), (1, 5, [0, 2]), (2, 4, [0, 1])]


def test_canonical_urls(spark):
    want = {
        "http://a.org:443/x": "http://a.org:443/x",
        "https://a.org:80/x": "https://a.org:80/x",
        "HTTP://A.org:80": "http://a.org/",
        "https://A.org:443/X?b&a": "https://a.org/X?a&b",
        "ftp://a.org:80/": "ftp://a.org:80/",
        "http://u:P@A.org:80/": "http://u:P@a.org/",
        "http://u@V:80@A.org/": "http://u@V:80@a.org/",
        "a.org:80/x#y": "a.org:80/x",
    }
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", revisits.canonical(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == want


def test_columns_with_the_names_of_helpers_stay(odd):
    names = ["_sha", "_words", "_n", "_turn", "_copy", "_score", "_id", "_size", "_copies", "_rows", "_keep_id", "_keep_sha"]
    docs = odd.select("*", *(F.concat(F.lit(n), F.col("score").cast("string")).alias(n) for n in names))
    for got in (exact_dedup.drop_duplicates(docs), mixing.mixed(docs)):
        rows = got.collect()
        assert got.columns == docs.columns and rows
        assert all(r[n] == (None if r["score"] is None else f"{n}{r['score']}") for r in rows for n in names)


def test_revisits(spark):
    head = lambda **kv: {k.replace("_", "-"): v for k, v in kv.items()}
    rows = [
        (1, "response", "http://A.org:80/x?b=1&a=2#f", 100, head(ETag='"1"', Content_Type="t", Date="1"), "c"),
        (2, "response", "http://a.org/x?a=2&b=1", 200, head(etag='"2"'), "c"),
        (3, "revisit", "HTTP://a.org/x?a=2&b=1&utm_s=1", 150, head(etag='W/"1"', date="9", content_length="0"), "c"),
        (4, "revisit", "http://a.org/x?a=2&b=1", 90_000, head(etag='"1"'), "c"),
        (5, "revisit", "http://a.org/x?a=2&b=1", 100, None, "c"),
        (6, "revisit", None, 300, {}, "c"),
        (7, "revisit", "http://a.org/x?a=2&b=1", 250, {}, "c"),
    ]
    records = spark.createDataFrame(rows, "record_id long, kind string, uri string, time long, headers map<string,string>, verdict string")
    for slot in (60, 86_400, 10**9):
        got = {r["record_id"]: (r["ref_id"], r["verdict"], r["headers"]) for r in revisits.resolve(records, slot).collect()}
        assert got[3] == (1, "resolved", {"etag": 'W/"1"', "content-type": "t", "date": "9"})
        assert got[4][:2] == (2, "mismatch") and got[5][:2] == (None, "orphan") and got[6][:2] == (None, "orphan") and got[7][:2] == (2, "unverified")
    assert revisits.resolve(records.where("false")).count() == 0


def test_revisits_odd_rows(spark):
    """Repeated rows, null ids and orphans; the response's columns reach resolved revisits only."""
    rows = [
        (1, "response", "http://a.org/", 100, {"etag": "1"}, "p1"),
        (1, "response", "http://a.org/", 100, {"etag": "1"}, "p1"),
        (None, "response", "http://a.org/", 120, {"etag": "0"}, "p0"),
        (2, "revisit", "http://a.org/", 150, {"etag": "1"}, None),
        (2, "revisit", "http://a.org/", 150, {"etag": "1"}, None),
        (None, "revisit", "http://a.org/", 160, {"etag": "2"}, None),
        (3, "revisit", "http://b.org/", 160, None, None),
        (4, "revisit", "http://a.org/", None, {}, None),
        (5, None, "http://a.org/", 170, {}, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, kind string, uri string, time long, headers map<string,string>, payload string")
    got = [(r["record_id"], r["ref_id"], r["verdict"], r["payload"]) for r in revisits.resolve(records, carry=("payload",)).collect()]
    want = [(2, 1, "resolved", "p1"), (2, 1, "resolved", "p1"), (None, 1, "mismatch", None), (3, None, "orphan", None), (4, None, "orphan", None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_url_models(spark):
    urls = [f"http://x.{'org' if i % 2 else 'com'}/{'fr' if i % 2 else 'de'}/{i}" for i in range(200)]
    rows = [*enumerate(urls), (900, None), (901, "no address"), (902, "https://b.net/fr/3"), (903, "https://b.net/de/4"), (904, "HTTPS://Sub.Example.ORG?x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in url_model.judge(pages).collect()}
    assert len(got) == len(rows) and (got[900]["host"], got[900]["path"], got[900]["rule"]) == ("", "", None)
    assert got[902]["verdict"] == "allow" and got[903]["verdict"] == "block"
    assert got[904]["host"] == "sub.example.org" and got[904]["path"] == "" and got[904]["rule"] is None
    assert url_model.judge(pages.where("false")).count() == 0


def test_url_models_read_whole_urls(spark):
    urls = [u for i in range(150) for u in (f"http://x.com/fr/p?list={i}#top", f"http://x.com/de/p?track={i}")]
    asked = ["https://b.net/p?list=7#top", "https://b.net/p?track=7", "b.net/p?list=7#top", "b.net/p?track=7"]
    pages = spark.createDataFrame(list(enumerate(asked + urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_model.judge(pages).collect()}
    assert [got[i]["verdict"] for i in range(4)] == ["allow", "block", "allow", "block"]
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 3)] == [("b.net", "/p", None), ("", "", None)]


def test_url_model_equals_brute_force(spark):
    texts = ["ab/c", "ab/d", "xy", ""]
    labels = [1, 1, 0, 0]
    model = url_model.learn(spark.createDataFrame(list(zip(texts, labels)), "text string, label int"))
    seen = [[collections.Counter() for _ in range(5)] for _ in range(2)]
    edge = "\x01"
    for t, c in zip(texts, labels):
        line = edge * 5 + t + edge
        for i in range(5, len(line)):
            for k in range(5):
                seen[c][k][line[i - k : i][::-1], line[i]] += 1

    def log(t, c):
        line, total = edge * 5 + t + edge, 0.0
        for i in range(5, len(line)):
            p = 1 / 256
            for k in range(5):
                own = {y: n for (x, y), n in seen[c][k].items() if x == line[i - k : i][::-1]}
                if own:
                    p = (own.get(line[i], 0) + len(own) * p) / (sum(own.values()) + len(own))
            total += np.log(p)
        return total

    tests = ["ab/c", "x", "", "zzz"]
    want = [(log(t, 1) - log(t, 0)) / (len(t) + 1) for t in tests]
    assert model.difference(pa.array(tests)) == pytest.approx(want, rel=1e-4)


def test_url_model_is_exact_beyond_32768_contexts(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_"
    texts = ["".join(rng.choice(letters) for _ in range(12)) + "/id" for _ in range(6000)]
    labels = [i % 3 % 2 for i in range(len(texts))]
    seen = [[collections.defaultdict(collections.Counter) for _ in range(5)] for _ in range(2)]
    edge = "\x01"
    for t, c in zip(texts, labels):
        line = edge * 5 + t + edge
        for i in range(5, len(line)):
            for k in range(5):
                seen[c][k][line[i - k : i]][line[i]] += 1
    assert len(seen[0][4]) > 32_768

    def log(t, c):
        line, total = edge * 5 + t + edge, 0.0
        for i in range(5, len(line)):
            p = 1 / 256
            for k in range(5):
                own = seen[c][k].get(line[i - k : i])
                if own:
                    p = (own[line[i]] + len(own) * p) / (sum(own.values()) + len(own))
            assert p <= 1
            total += np.log(p)
        return total

    tests = [*texts[:200], *(t[6:] + t[:6] for t in texts[:200])]
    model = url_model.learn(spark.createDataFrame(list(zip(texts, labels)), "text string, label int"))
    want = [(log(t, 1) - log(t, 0)) / (len(t) + 1) for t in tests]
    assert model.difference(pa.array(tests)) == pytest.approx(want, abs=1e-6)


def test_classifiers_on_held_out_rows(spark, odd, none):
    random.seed(6)
    clean = [" ".join(random.choice(["sun", "tree", "river", "stone"]) for _ in range(40)) for _ in range(300)]
    rows = [(i, t + (" vile" if i % 3 == 0 else ""), "en", i % 3 == 0) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bad boolean")
    labels = docs.where("doc_id < 200").select("doc_id", F.col("bad").cast("int").alias("label"))
    net = conv.learn(docs, labels)
    got = conv.scored(docs.where("doc_id >= 200"), net).collect()
    assert np.mean([(r["score"] >= 0.5) == r["bad"] for r in got]) > 0.95
    shouted = docs.withColumn("text", F.when(F.col("bad"), F.upper("text")).otherwise(F.col("text")))
    ranker = ranking.learn(shouted, labels.withColumn("label", 1 - F.col("label")))
    got = ranking.scored(shouted.where("doc_id >= 200"), ranker).collect()
    assert np.mean([(r["score"] < ranking.KEEP_AT) == r["bad"] for r in got]) > 0.95
    for made in (conv.scored(odd, net), ranking.scored(odd, ranker)):
        scores = [r["score"] for r in made.collect()]
        assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    empty = labels.where("false")
    assert conv.scored(none, conv.learn(none, empty)).count() == 0
    assert ranking.scored(none, ranking.learn(none, empty)).count() == 0


def test_blocks_of_words_do_not_change_scores(monkeypatch):
    net, words = conv.Network.new(1), conv.Words()
    texts = [words.of(t) for t in ("a b c d e f g " * 40, "", "h i", "a " * 300)]
    whole = net.logits(texts, words.table())
    monkeypatch.setattr(conv, "BLOCK", 7)
    assert net.logits(texts, words.table()) == pytest.approx(whole, rel=1e-5)
