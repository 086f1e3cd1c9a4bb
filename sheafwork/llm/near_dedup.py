"""Near duplicates by DartMinHash signatures, banded joins and exact checks.

Darts are thrown at every element of a weighted set: a Poisson process over (weight, rank), drawn by
hashing, so equal elements get equal darts in all sets. A dart hits if its weight lies below the
element's; each dart belongs to one coordinate, and the hit of lowest rank is the signature's entry
there. Two sets agree in a coordinate with the chance of their weighted Jaccard similarity. Ranks
are only followed as far as a set needs to fill all coordinates, so the work is about one dart for
each element and a fixed number for each set.

A document's shingles weigh as often as they occur, so its similarity to another is the sum of the smaller
weights over the sum of the larger ones. For the exact checks each occurrence of a shingle is an element of its own,
the first, the second and so on: the Jaccard similarity of such sets is the weighted one.

Documents with one set stand for each other. In every band's bucket all others are compared with the
bucket's smallest document; what is not linked that way is then compared across the classes found,
so that every pair of a bucket is either compared or already in one class.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import append, buffer_of, keep, mix, new_folder, word_hashes

WORDS = 5
SIMILAR = 0.8
#: 56 bands of 8: a pair at similarity 0.8 misses all of them with a chance of 3e-5, one at 0.3 meets in one of 300.
BANDS, ROWS = 56, 8
_U = np.uint64


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (hashes), how often each occurs, and the number of shingles before each text.

    Words stand between white space and count in lower case. A text of fewer words is one shingle, one
    without words has none.
    """
    raw, at = buffer_of(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    hashed, before = word_hashes(raw, at)
    count = np.diff(before)
    n = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + before[:-1][owner]
    padded = np.concatenate((hashed, np.zeros(words, np.uint64)))
    value = np.zeros(len(start), np.uint64)
    for j in range(words):
        factor = _U(pow(0xD1342543DE82EF95, j + 1, 1 << 64))
        value += np.where(j < count[owner], padded[start + j], _U(0)) * factor
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.concatenate((first, [len(value)])))
    return value[first], times, np.searchsorted(owner[first], np.arange(len(texts) + 1))


def _poisson(bits: int = 16) -> np.ndarray:
    """Poisson counts of mean 1 by the upper ``bits`` of a hash."""
    share = np.cumsum([np.exp(-1.0) / factorial(i) for i in range(12)])
    return np.searchsorted(share, (np.arange(1 << bits) + 0.5) / (1 << bits)).astype(np.uint8)


#: Ranks are fixed-point numbers: a cell's number above, the place in the cell in the lower 40 bits.
_PLACE = 40
_COUNTS = _poisson()
_NEVER = _U(2**64 - 1)
#: Sets whose darts are thrown together; some 4,000 darts each for 448 entries.
TOGETHER = 16


def signatures(value: np.ndarray, weight: np.ndarray, before: np.ndarray, k: int) -> np.ndarray:
    """``k`` entries for each set; those of empty sets are 0.

    ``value`` and ``weight`` (above 0) list the sets' elements, ``before`` says where each set starts.
    Weights far below 1 in sum (2e-4 for 448 entries) must be scaled up: ranks end at 2 ** 24.
    """
    out = np.zeros((len(before) - 1, k), np.uint64)
    for i in range(0, len(out), TOGETHER):
        edges = before[i : i + TOGETHER + 1]
        own = slice(edges[0], edges[-1])
        _fill(out[i : i + TOGETHER], value[own], weight[own], edges - edges[0])
    return out


def _fill(out: np.ndarray, value: np.ndarray, weight: np.ndarray, before: np.ndarray) -> None:
    sets, k = out.shape
    owner = np.repeat(np.arange(sets), np.diff(before))
    mass = np.bincount(owner, weight, sets)
    todo = mass > 0
    darts = k * np.log(max(k, 2)) + 2 * k
    reach = np.where(todo, darts / np.where(todo, mass, 1), 0.0)
    while todo.any():
        if reach[todo].max() >= 1 << (64 - _PLACE):
            raise ValueError("the weights are too small: scale them up")
        use = todo[owner]
        local = np.cumsum(todo) - 1
        entry = _thrown(value[use], weight[use], local[owner[use]], reach[todo], k)
        full = (entry != _NEVER).all(1)
        rows = np.flatnonzero(todo)
        out[rows[full]] = entry[full]
        todo[rows[full]] = False
        reach *= 1.5  # a set with an empty coordinate follows its darts further


def _thrown(value: np.ndarray, weight: np.ndarray, owner: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
    """The lowest rank up to ``reach`` in each coordinate; it also names the dart."""
    best = np.full(len(reach) * k, _NEVER)
    limit = (reach * 2.0**_PLACE).astype(np.uint64)
    # Weights are cut into (0, 1], (1, 2], (2, 4], ...: one process each, as dense as the piece is wide.
    top = weight.max(initial=0)
    low, level = 0.0, 0
    while low < top:
        high = 1.0 if level == 0 else low * 2
        live = np.flatnonzero(weight > low)
        # Cells of rank in which one dart is expected; their number and the element draw how many there are.
        cells = np.ceil(reach * (high - low)).astype(np.int64)[owner[live]]
        at = np.repeat(live, cells)
        cell = _within(cells)
        seed = mix(value + _U((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64)))
        drawn = mix(seed[at] + cell.astype(np.uint64) * _U(0xA0761D6478BD642F))
        count = _COUNTS[drawn >> _U(48)]
        pair = np.repeat(np.arange(len(at)), count)
        dart = mix(drawn[pair] + (_within(count) + 1).astype(np.uint64) * _U(0xE7037ED1A0B428DB))
        at = at[pair]
        rank = ((cell[pair].astype(np.uint64) << _U(_PLACE)) | (dart & _U((1 << _PLACE) - 1))) >> _U(max(level - 1, 0))
        mine = owner[at]
        on = rank < limit[mine]
        if (weight[live] < high).any():
            height = (mix(dart ^ _U(0x8EBC6AF09C88C6E3)) >> _U(11)).astype(float) / 2.0**53
            on &= low + (high - low) * height < weight[at]
        coordinate = ((dart >> _U(_PLACE)) * _U(k) >> _U(64 - _PLACE)).astype(np.int64)
        np.minimum.at(best, (mine * k + coordinate)[on], rank[on])
        low, level = high, level + 1
    return best.reshape(-1, k)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of these lengths."""
    counts = counts.astype(np.int64)
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band, of its number and its entries."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    parts = signature[:, : bands * rows].reshape(-1, bands, rows)
    for r in range(rows):
        key = mix(key * _U(0x8EBC6AF09C88C6E3) + parts[:, :, r])
    return key


def occurrences(value: np.ndarray, times: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An element for every occurrence of a shingle, and the number of elements before each text.

    The first occurrence is named by the shingle alone, a later one also by its number.
    """
    number = _within(times).astype(np.uint64)
    named = np.repeat(value, times)
    later = number > 0
    named[later] = mix(named[later] + number[later] * _U(0x9FB21C651E98DF25))
    return named, np.concatenate(([0], np.cumsum(times)))[before]


def _sketched(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``id, n, f1, f2, keys``: number of shingles, a name of the weighted set in 128 bits, band keys."""

    def work(texts: pa.Array) -> list[pa.Array]:
        value, times, before = shingles(texts, words)
        signature = signatures(value, times.astype(float), before, bands * rows)
        value, before = occurrences(value, times, before)
        n = np.diff(before)
        keys = band_keys(signature, bands, rows).view(np.int64)
        sums = []
        for salt in (0x589965CC75374CC3, 0x1D8E4E27C47D124F):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ _U(salt)), dtype=np.uint64)))
            sums.append((total[before[1:]] - total[before[:-1]]).view(np.int64))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
        return [pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), listed]

    made = append(docs.select("id", "text"), "text", "n long, f1 long, f2 long, keys array<long>", lambda: work, 1 << 20)
    return made.drop("text")


def _listed(docs: DataFrame, words: int) -> DataFrame:
    """``id, s``: the occurrences of a text's shingles."""

    def work(texts: pa.Array) -> list[pa.Array]:
        value, before = occurrences(*shingles(texts, words))
        return [pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(value.view(np.int64)))]

    return append(docs.select("id", "text"), "text", "s array<long>", lambda: work).drop("text")


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _linked(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(jaccard(F.col("sa"), F.col("sb")) >= similar).select("a", "b").distinct()


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """``id, label`` for every id in the links ``a, b``: the smallest id that it is connected with.

    Each round takes the smallest label among neighbours, and then that label's own label.
    """
    edges = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, f"{name}-edges")
    labels = keep(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), folder, f"{name}-0")
    step = 0
    while True:
        step += 1
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = keep(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), folder, f"{name}-{step}-hooked")
        above = hooked.select(F.col("id").alias("label"), F.col("label").alias("above"))
        moved = hooked.join(above, "label").select("id", "old", F.least("label", "above").alias("label"))
        moved = keep(moved, folder, f"{name}-{step}")
        labels = moved.drop("old")
        if moved.where("old <> label").isEmpty():
            return labels


def _across(inside: DataFrame, sets: DataFrame, similar: float, folder: str) -> DataFrame:
    """Pairs of different classes of which one is outside its bucket's largest class and that may be similar.

    Two sets this similar share one of their rarest shingles, in one order for all: one of the first
    ``n - ceil(similar * n) + 1``. So only those are joined; shingles that a single document has drop out.
    """
    ids = inside.select("id", "label").distinct()
    # Texts of one id are told apart by their sets: places are counted within a set.
    tokens = sets.join(ids, "id").select("id", "label", F.xxhash64("s").alias("set"), F.size("s").alias("n"), F.explode("s").alias("t"))
    tokens = keep(tokens, folder, "tokens")
    rare = keep(tokens.groupBy("t").agg(F.count("*").alias("df")), folder, "rare")
    place = F.row_number().over(Window.partitionBy("id", "set").orderBy("df", "t"))
    first = F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1
    ranked = tokens.join(rare, "t").withColumn("k", place).where(F.col("k") <= first).where("df > 1")
    prefix = keep(ranked.select("id", "label", "t", "n", "k"), folder, "prefix")
    outside = inside.where("label <> largest").select(F.col("id").alias("x")).distinct()
    left = prefix.join(outside, F.col("id") == F.col("x"), "left_semi").select(F.col("id").alias("x"), F.col("label").alias("lx"), "t", F.col("n").alias("nx"), F.col("k").alias("kx"))
    right = prefix.select(F.col("id").alias("y"), F.col("label").alias("ly"), F.col("t").alias("u"), F.col("n").alias("ny"), F.col("k").alias("ky"))
    # From the first shingle that they share on, enough must be left on both sides for all that they have to share.
    left_over = F.least(F.col("nx") - F.col("kx"), F.col("ny") - F.col("ky")) + 1
    enough = left_over >= (F.col("nx") + F.col("ny")) * (similar / (1 + similar)) - 1e-6
    met = left.join(right, (F.col("t") == F.col("u")) & (F.col("lx") != F.col("ly")) & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similar: float = SIMILAR,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row for each input row: the id, ``class_id`` and ``class_size`` (in rows).

    Documents are linked if the weighted Jaccard similarity of their word shingles, each as heavy as it occurs
    often, reaches ``similar``; a class is what links connect, named by its smallest id. A text without words is linked with
    none; a null text has no words. A null id is a class of its own, named null. Rows of one id are one
    document: it is linked if any of its texts is.
    """
    folder = new_folder(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketches = keep(_sketched(texts, words, bands, rows), folder, "sketches")
    same = sketches.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    same = keep(same, folder, "same")
    copies = keep(sketches.where("n > 0").select("id", "n", "f1", "f2").join(same, ["n", "f1", "f2"]).select("id", "rep").distinct(), folder, "copies")
    one = sketches.join(same, ["n", "f1", "f2"]).where("id = rep").select("id", F.explode("keys").alias("key")).distinct()
    places = keep(one, folder, "places")
    shared = keep(places.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("m")).where("m > 1"), folder, "shared")
    members = keep(places.join(shared, "key").select("key", "id", "pivot"), folder, "members")
    sets = keep(_listed(texts.join(members.select("id").distinct(), "id", "left_semi"), words), folder, "sets")
    pairs = keep(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), folder, "pairs-1")
    own = copies.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = keep(_linked(pairs, sets, similar), folder, "links-1")
    found = components(links, folder, "found")
    # Buckets that still hold several classes: whoever is not of the largest meets all of other classes.
    labelled = members.join(found, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    labelled = keep(labelled, folder, "labelled")
    held = labelled.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed = held.groupBy("key").agg(F.max(F.struct("m", "label")).alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = keep(mixed.select("key", F.col("largest.label").alias("largest")), folder, "mixed")
    inside = keep(labelled.join(mixed, "key"), folder, "inside")
    across = keep(_across(inside, sets, similar, folder).join(pairs, ["a", "b"], "left_anti"), folder, "pairs-2")
    every = links.unionByName(_linked(across, sets, similar)).unionByName(own)
    final = components(every, folder, "final")
    rows_ = docs.select(F.col(id_col).alias("id")).join(final, "id", "left").select("id", F.coalesce("label", "id").alias("class_id"))
    rows_ = keep(rows_, folder, "rows")
    sizes = keep(rows_.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("class_size")), folder, "sizes")
    sized = rows_.join(sizes, "class_id", "left")
    return sized.select(F.col("id").alias(id_col), "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the documents that are near copies of one with a smaller id; columns as they were.

    Null and empty texts, null ids and rows of one id are as in :func:`classes`: texts without words and null ids
    all stay, and rows of one id stay or go together. An empty table stays empty.
    """
    folder = new_folder(docs.sparkSession)
    found = classes(docs, id_col, text_col)
    gone = keep(found.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("_gone")).distinct(), folder, "gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
