"""Quality by pairwise ranking (Bradley-Terry): scores learned from which of two documents is better.

A document's worth is a weighted sum of features of its whole text. For a pair, the chance that the first
is the better one is the logistic function of the difference of their worths; the weights minimise
the logistic loss on feature differences. A document is kept if its worth reaches a quantile of
all documents' worths; labelled rows kept aside choose which quantile.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import append, buffer_of, sampled, word_hashes

#: Kinds of bytes: other, blank, line end, a-z, A-Z, digit, sentence marks, "!", bars, signs, brackets and quotes, beyond ASCII.
_KINDS = [b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?-", b"!", b"|/\\", b"#$%&*+=@^_~", b"()[]{}<>\"'`"]
KIND = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(_KINDS):
    KIND[list(_bytes)] = _i + 1
KIND[128:] = len(_KINDS) + 1
KINDS = len(_KINDS) + 2
FEATURES = KINDS * KINDS + 6
BLOCK = 1 << 20
KEEP_AT = 0.7  # the score at the threshold
#: Worths are counted in as many equal cells between the least and the greatest worth of the rows kept aside.
CELLS = 4096


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers for each whole text; a null text is empty.

    Square roots of the shares of byte-kind pairs, then: shares of words like the one before, the second
    before, of repeated words among neighbours, mean word length, and logarithms of words and bytes.
    """
    raw, at = buffer_of(texts)
    n = len(texts)
    pairs = np.zeros(n * KINDS * KINDS)
    kind = KIND[raw]
    which = np.repeat(np.arange(n), np.diff(at))
    for i in range(0, len(raw) - 1, BLOCK):
        here, there = slice(i, min(i + BLOCK, len(raw) - 1)), slice(i + 1, min(i + BLOCK, len(raw) - 1) + 1)
        code = (which[here] * KINDS + kind[here]) * KINDS + kind[there]
        low = which[i] * KINDS * KINDS
        found = np.bincount(code[which[here] == which[there]] - low)
        pairs[low : low + len(found)] += found
    size = np.maximum(np.diff(at) - 1, 1)
    out = np.zeros((n, FEATURES))
    out[:, : KINDS * KINDS] = np.sqrt(pairs.reshape(n, -1) / size[:, None])
    words, before = word_hashes(raw, at)
    count = np.diff(before)
    owner = np.repeat(np.arange(n), count)
    most = np.maximum(count, 1)
    for k in (1, 2):
        same = (words[k:] == words[:-k]) & (owner[k:] == owner[:-k])
        out[:, KINDS * KINDS + k - 1] = np.bincount(owner[k:][same], minlength=n) / most
    # Different words among all: a text that says little over and over has few.
    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (o[1:] != o[:-1]))) if len(w) else np.zeros(0, bool)
    out[:, KINDS * KINDS + 2] = np.bincount(o[new], minlength=n) / most
    out[:, KINDS * KINDS + 3] = np.log1p(np.diff(at) / most)
    out[:, KINDS * KINDS + 4] = np.log1p(count) / 10
    out[:, KINDS * KINDS + 5] = np.log1p(np.diff(at)) / 10
    return out


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0  # worth at the chosen quantile
    quantile: float = 0.0
    slope: float = 1.0
    constant: float | None = None
    aside_worth: np.ndarray = field(default_factory=lambda: np.zeros(0))  # rows not trained on, and their labels
    aside_label: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and ``KEEP_AT`` at the threshold."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.slope * (self.worth(x) - self.threshold) + np.log(KEEP_AT / (1 - KEEP_AT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights of least mean logistic loss on ``better - worse``, by accelerated gradient descent."""
    d = better - worse
    bound = 0.25 * np.linalg.norm(d, 2) ** 2 / len(d) + penalty
    w = ahead = np.zeros(d.shape[1])
    for k in range(steps):
        pull = 1 / (1 + np.exp(np.clip(d @ ahead, -30, 30)))
        new = ahead - (penalty * ahead - d.T @ pull / len(d)) / bound
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def train(x: np.ndarray, want: np.ndarray, share: float, rounds: int = 8, seed: int = 11) -> Ranker:
    """Learn from a sample of rows with labels 1 (better) and 0; ``share`` of all labelled rows are 1.

    Every fifth row is kept aside to choose the quantile (all rows, if that leaves a class out). In each round every row meets one drawn row of the
    other class. Without rows of both classes all scores are ``share``.
    """
    mean, spread = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    ranker = Ranker(mean, spread, np.zeros(FEATURES))
    aside = np.arange(len(x)) % 5 == 4
    good, bad = np.flatnonzero((want == 1) & ~aside), np.flatnonzero((want == 0) & ~aside)
    if not len(good) or not len(bad):
        ranker.constant = share
        return ranker
    random = np.random.default_rng(seed)
    z = np.clip((x - mean) / spread, -8, 8)
    first = np.concatenate([np.concatenate((good, random.choice(good, len(bad)))) for _ in range(rounds)])
    second = np.concatenate([np.concatenate((random.choice(bad, len(good)), bad)) for _ in range(rounds)])
    ranker.weights = fit_pairs(z[first], z[second])
    test = np.flatnonzero(aside) if len(set(want[aside].tolist())) == 2 else np.arange(len(x))
    ranker.aside_worth, ranker.aside_label = ranker.worth(x[test]), want[test]
    good_worth, bad_worth = (ranker.aside_worth[ranker.aside_label == c] for c in (1, 0))
    gap = np.median(good_worth) - np.median(bad_worth)
    ranker.slope = float(6 / gap) if gap > 0 else 1.0
    # Until the corpus is ranked, its worths are taken to be spread as in the rows kept aside, by their classes' shares.
    edges = cell_edges(ranker)
    low, high = (np.histogram(w, edges)[0] for w in (bad_worth, good_worth))
    return at_quantile(ranker, np.concatenate(([0.0], (1 - share) * low / len(bad_worth) + share * high / len(good_worth), [0.0])))


def cell_edges(ranker: Ranker) -> np.ndarray:
    """``CELLS + 1`` bounds of the cells in which worths are counted; a bound belongs to the cell above it."""
    low, high = ranker.aside_worth.min(), ranker.aside_worth.max()
    width = max(high - low, 1e-6) / (CELLS - 2)
    return low + width * (np.arange(CELLS + 1) - 1)


def at_quantile(ranker: Ranker, counts: np.ndarray) -> Ranker:
    """The threshold at the quantile of best balanced accuracy on the rows kept aside.

    ``counts`` has the worths below the first bound, in every cell, and from the last bound on. Of quantiles
    that are equally good the one nearest to their middle is taken, of bounds at one quantile the middle one.
    """
    edges = cell_edges(ranker)
    at = np.cumsum(counts[:-1]) / max(counts.sum(), 1e-300)
    worth = [np.sort(ranker.aside_worth[ranker.aside_label == c]) for c in (0, 1)]
    below = [np.searchsorted(w, edges, side="left") / len(w) for w in worth]
    right = below[0] + 1 - below[1]
    best = np.flatnonzero(np.isclose(right, right.max()))
    off = np.abs(at[best] - (at[best[0]] + at[best[-1]]) / 2)
    nearest = best[np.isclose(off, off.min(), atol=1e-12)]
    cut = nearest[len(nearest) // 2]
    return replace(ranker, quantile=float(at[cut]), threshold=float(edges[cut]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 4000) -> Ranker:
    """Train on about ``rows`` labelled documents of each class, chosen by a hash of the id.

    ``labels`` has the id and ``label``; labels other than 0 and 1 are left out, and so are ids without a document.
    Rows of one id are all taken. Null and empty texts are texts without words. Whole texts become features where they are read; only
    features reach the driver, ``FEATURES`` numbers for each of the rows.
    """
    known = labels.where("label in (0, 1)").select(F.col(id_col).alias("_id"), F.col("label").cast("int").alias("_label"))
    total, ones = known.agg(F.count("*"), F.sum("_label")).first()
    some = sampled(known, "_label", "_id", rows, 2).limit(3 * rows)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(some), F.col("_doc") == F.col("_id"))
    made = append(texts.select("_doc", "_label", "_text"), "_text", "_x array<float>", lambda: lambda t: [pa.array(features(t).astype(np.float32).tolist(), pa.list_(pa.float32()))])
    got = made.select("_doc", "_label", "_x").toArrow().sort_by([("_doc", "ascending"), ("_label", "ascending")])
    flat = got.column("_x").combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0)
    return train(flat.reshape(-1, FEATURES).astype(float), got.column("_label").to_numpy(), (ones or 0) / max(1, total))


def worths(docs: DataFrame, ranker: Ranker, text_col: str = "text", out: str = "worth") -> DataFrame:
    """Add the worth of every whole text, empty and null ones too; a column named ``out`` is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranker)
    return append(docs, text_col, f"`{out}` double", lambda: lambda t: [pa.array(np.round(shipped.value.worth(features(t)), 9))])


def cut_at_quantile(ranked: DataFrame, ranker: Ranker, worth: str = "worth") -> Ranker:
    """The ranker with its threshold at a quantile of all rows' worths.

    Worths are counted by cell where they are read; at most ``CELLS + 2`` counts reach the driver, whatever the
    table's size. Without rows, or for a ranker without rows of both classes, the ranker stays as it is.
    """
    if ranker.constant is not None:
        return ranker
    edges = cell_edges(ranker)
    cell = F.floor((F.col(worth) - float(edges[0])) / float(edges[1] - edges[0])) + 1
    inside = F.least(F.greatest(cell, F.lit(0)), F.lit(CELLS + 1)).cast("int")
    counts = np.zeros(CELLS + 2)
    for row in ranked.groupBy(inside.alias("cell")).agg(F.count("*").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return at_quantile(ranker, counts) if counts.any() else ranker


def score_of(ranker: Ranker, worth: str = "worth") -> Column:
    """The score, 0 to 1, of a column of worths; ``KEEP_AT`` at the threshold."""
    if ranker.constant is not None:
        return F.lit(float(ranker.constant))
    z = F.lit(ranker.slope) * (F.col(worth) - F.lit(ranker.threshold)) + F.lit(float(np.log(KEEP_AT / (1 - KEEP_AT))))
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def scored(docs: DataFrame, ranker: Ranker, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every whole text, empty and null ones too, at the ranker's threshold.

    Equal texts have equal scores. A column named ``out`` is replaced, all others stay; an empty table stays empty.
    """
    return worths(docs, ranker, text_col, out).withColumn(out, score_of(ranker, out))
