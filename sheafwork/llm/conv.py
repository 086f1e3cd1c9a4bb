"""Toxicity by a small convolutional network over hashed words, in numpy.

A word's embedding is the mean of hashed vectors for the word and its beginnings and end. Filters
of several widths run over the words, the largest answer of each filter over the whole text is kept, and a
logistic unit scores them. The network starts from a bounded sample of labelled rows. Then the tasks train it on
every labelled row's whole text, each on its own rows, and their changes are averaged; only the rows of every fifth
hash are kept from it, and all of those calibrate the scores. Every text is then scored whole, in the tasks that read it. Scores
depend on the text alone. Thresholds are calibrated by language, for decisions only.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import Memory, append, keep, new_folder, pieces, sampled, stretches

TABLE = 1 << 15
PIECES = 6  # hashed vectors of a word
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
BLOCK = 1 << 16
#: Words that a task holds before it starts anew, and bytes of text that it scores together.
MOST_WORDS = 120_000
TEXT_BYTES = 1 << 20
#: Labelled rows that a task trains on, on average; how often it goes over each slice of them; rows of a step.
TASK_ROWS = 4096
PASSES = 2
STEP_ROWS = 32
#: Rows of parameters that travel together, and tasks whose changes are added up together.
PART = 1024
FAN = 64
#: Logits are counted in steps of 1 / STEPS up to BOUND on both sides.
STEPS, BOUND = 256, 64
_PAD = 0
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


_WHOLE, _END, *_STARTS = (zlib.crc32(c) for c in (b"w", b"e", b"3", b"4", b"5", b"6"))
_CLOSING = frozenset(".,;:!?")


def hashes_of(word: str) -> tuple[int, ...]:
    """Hashes of a word: itself, its first 3 to 6 letters, its last 3, each behind a mark of its kind."""
    raw, crc = word.encode(), zlib.crc32
    if len(raw) == len(word):
        return crc(raw, _WHOLE), crc(raw[:3], _STARTS[0]), crc(raw[:4], _STARTS[1]), crc(raw[:5], _STARTS[2]), crc(raw[:6], _STARTS[3]), crc(raw[-3:], _END)
    return crc(raw, _WHOLE), *(crc(word[:n].encode(), c) for n, c in zip((3, 4, 5, 6), _STARTS)), crc(word[-3:].encode(), _END)


def rows_of(hashes: list[tuple[int, ...]]) -> np.ndarray:
    """Rows of the embedding table for the hashes of words."""
    return (1 + np.array(hashes, np.int64) % (TABLE - 1)).astype(np.int32)


def letters_of(stretch: str) -> str:
    """The stretch without what is no letter, mark or digit, in small letters."""
    if stretch.isalnum():
        return stretch.lower()
    if stretch and stretch[-1] in _CLOSING and stretch[:-1].isalnum():
        return stretch[:-1].lower()
    return _NOT_LETTERS.sub("", stretch).lower()


class Words:
    """Numbers for the words met in this task's texts, and their rows of the table.

    Hashes of new words wait in a list until the table is asked for, and then only stand there.
    """

    def __init__(self):
        self.new: list[tuple[int, ...]] = []
        self.numbers: dict[str, int] = {"": 0}
        self.stretch = Memory(self._number)
        self._table = np.array([(_PAD,) * PIECES], np.int32)

    def _number(self, stretch: str) -> int:
        word = letters_of(stretch)
        number = self.numbers.get(word)
        if number is None:
            number = self.numbers[word] = len(self.numbers)
            self.new.append(hashes_of(word))
        return number

    def of(self, text: str | None) -> np.ndarray:
        """Word numbers of a whole text, without empty words."""
        found = [np.fromiter(map(self.stretch.__getitem__, part), np.int32, len(part)) for part in stretches(text or "")]
        numbers = np.concatenate(found)
        return numbers[numbers > 0]

    def full(self) -> bool:
        return len(self.numbers) > MOST_WORDS

    def table(self) -> np.ndarray:
        if self.new:
            self._table = np.concatenate((self._table, rows_of(self.new)))
            self.new = []
        return self._table


def _line(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each behind pads of its own, and where each one's pads start.

    A filter that starts in a text or its pads ends in it or in the next text's pads, so none spans two texts.
    """
    gap = np.zeros(max(WIDTHS), np.int32)
    parts: list[np.ndarray] = []
    for t in texts:
        parts += [gap, t]
    starts = np.cumsum([0, *(len(t) + len(gap) for t in texts)])
    return np.concatenate(parts) if parts else gap[:0], starts


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)  # calibrated logit: scale[0] * logit + scale[1]
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        random = np.random.default_rng(seed)
        draw = lambda *shape: random.normal(0, 1 / np.sqrt(DIM), shape).astype(np.float32)
        return cls(draw(TABLE, DIM), [draw(w, DIM, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(len(WIDTHS) * FILTERS), 0.0)

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        vectors = self.table[rows].mean(1)
        vectors[rows[:, 0] == _PAD] = 0
        return vectors

    def pooled(self, line: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The largest answer of every filter in every text, 0 at least, block by block."""
        best = np.zeros((len(starts) - 1, len(WIDTHS) * FILTERS), np.float32)
        # One width's answers at a time are in memory.
        for k, w in enumerate(WIDTHS):
            answers = [words @ self.filters[k][j] for j in range(w)]
            for at in range(0, len(line), BLOCK):
                some = line[at : at + BLOCK]
                reach = np.concatenate((line[at : at + BLOCK + max(WIDTHS) - 1], np.zeros(max(WIDTHS), np.int32)))
                first = np.searchsorted(starts, at, side="right") - 1
                last = np.searchsorted(starts, at + len(some), side="left")
                cuts = np.maximum(starts[first:last] - at, 0)
                total = answers[0][some]
                for j in range(1, w):
                    total = total + answers[j][reach[j : j + len(some)]]
                found = np.maximum.reduceat(total, cuts, axis=0) + self.biases[k]
                part = best[first:last, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(part, found, out=part)
        return best

    def logits(self, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        line, starts = _line(texts)
        used, line = np.unique(line, return_inverse=True)
        # Every text has pads, so the pad is the first of the words used.
        return self.pooled(line.astype(np.int32), starts, self.embedded(table[used])) @ self.out + self.bias

    def scores(self, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        z = self.scale[0] * self.logits(texts, table) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _step(net: Network, texts: list[np.ndarray], table: np.ndarray, want: np.ndarray, weight: np.ndarray, moments: dict, rate: float) -> None:
    """One step of gradient descent with per-parameter rates (Adagrad) on a few texts."""
    line, starts = _line(texts)
    used, line = np.unique(line, return_inverse=True)
    rows = table[used]
    words = net.embedded(rows)
    n = len(texts)
    best = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    place = np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
    reach = np.concatenate((line, np.zeros(max(WIDTHS), np.int64)))
    # A block of one width's answers at a time is in memory, however long a text is.
    for k, w in enumerate(WIDTHS):
        answers = [words @ net.filters[k][j] for j in range(w)]
        own_best, own_place = best[:, k * FILTERS : (k + 1) * FILTERS], place[:, k * FILTERS : (k + 1) * FILTERS]
        for start in range(0, len(line), BLOCK):
            stop = min(start + BLOCK, len(line))
            total = answers[0][line[start:stop]]
            for j in range(1, w):
                total += answers[j][reach[start + j : stop + j]]
            total += net.biases[k]
            for i in range(np.searchsorted(starts, start, side="right") - 1, np.searchsorted(starts, stop, side="left")):
                first = max(starts[i], start)
                part = total[first - start : min(starts[i + 1], stop) - start]
                at = part.argmax(0)
                top = part[at, np.arange(FILTERS)]
                better = top > own_best[i]
                own_best[i, better], own_place[i, better] = top[better], (at + first)[better]
    live = best > 0
    hidden = best * live
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30)))
    error = ((p - want) * weight / weight.sum()).astype(np.float32)
    back = error[:, None] * net.out[None, :] * live
    grads = {"out": hidden.T @ error, "bias": np.float32(error.sum())}
    to_words = np.zeros_like(words)
    for k, w in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        grads["b", k] = back[:, cols].sum(0)
        grad = np.zeros_like(net.filters[k])
        for j in range(w):
            at = reach[place[:, cols] + j]
            for f in range(FILTERS):
                grad[j, :, f] = words[at[:, f]].T @ back[:, cols][:, f]
                np.add.at(to_words, at[:, f], back[:, cols][:, f][:, None] * net.filters[k][j][:, f][None, :])
        grads["f", k] = grad
    to_words[used == _PAD] = 0

    def moved(key, grad):
        moments[key] = moments.get(key, 1e-6) + grad**2
        return rate * grad / np.sqrt(moments[key])

    net.out -= moved("out", grads["out"])
    net.bias -= float(moved("bias", grads["bias"]))
    for k in range(len(WIDTHS)):
        net.filters[k] -= moved(("f", k), grads["f", k])
        net.biases[k] -= moved(("b", k), grads["b", k])
    touched = np.flatnonzero(np.abs(to_words).sum(1))
    flat, values = rows[touched].ravel(), np.repeat(to_words[touched] / PIECES, PIECES, axis=0)
    at, inverse = np.unique(flat, return_inverse=True)
    total = np.zeros((len(at), DIM), np.float32)
    np.add.at(total, inverse, values)
    squares = moments.setdefault("table", np.full((TABLE, DIM), 1e-6, np.float32))
    squares[at] += total**2
    net.table[at] -= rate * total / np.sqrt(squares[at])


def calibrated(logit: np.ndarray, want: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the scores of rows not trained on."""
    if len(set(want.tolist())) < 2:
        return 1.0, 0.0
    a, b = 1.0, 0.0
    x = np.stack([logit, np.ones_like(logit)], 1).astype(float)
    # Labels are softened a little, so that classes that are wholly apart keep a finite slope.
    soft = np.where(want > 0, 0.995, 0.005)
    for _ in range(50):
        z = np.clip(a * x[:, 0] + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        grad = x.T @ (weight * (p - soft)) + 1e-6 * np.array([a, b])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def best_threshold(score: np.ndarray, want: np.ndarray, times: np.ndarray) -> float:
    """The threshold nearest to one half among those with the best balanced accuracy; a score stands for ``times`` rows."""
    score, which = np.unique(score, return_inverse=True)
    cuts = np.unique(np.concatenate(([0.5], (score[1:] + score[:-1]) / 2)))
    hit = np.zeros(len(cuts))
    for label in (0, 1):
        held = np.bincount(which, np.where(want == label, times, 0), len(score))
        below = np.concatenate(([0], np.cumsum(held)))[np.searchsorted(score, cuts)] / held.sum()
        hit += below if label == 0 else 1 - below
    good = cuts[np.isclose(hit, hit.max())]
    return float(good[np.abs(good - 0.5).argmin()])


def train(net: Network, moments: dict, numbered: list[np.ndarray], table: np.ndarray, want: np.ndarray, weight: np.ndarray, passes: int, random: np.random.Generator) -> None:
    """Go over the rows ``passes`` times, some rows a step; a step has at most ``BLOCK`` words, or one row."""
    for _ in range(passes):
        order = random.permutation(len(numbered))
        words = np.cumsum([len(numbered[j]) for j in order])
        start = 0
        while start < len(order):
            done = words[start - 1] if start else 0
            stop = max(start + 1, min(start + STEP_ROWS, int(np.searchsorted(words, done + BLOCK, side="right"))))
            some = order[start:stop]
            _step(net, [numbered[j] for j in some], table, want[some].astype(np.float32), weight[some], moments, 0.05)
            start = stop


def _parameters(net: Network) -> np.ndarray:
    """All parameters in rows of ``DIM``, the table first."""
    small = np.concatenate([*(f.ravel() for f in net.filters), *net.biases, net.out, [net.bias]]).astype(np.float32)
    return np.concatenate((net.table, np.pad(small, (0, -len(small) % DIM)).reshape(-1, DIM)))


def _with_parameters(net: Network, rows: np.ndarray) -> Network:
    small, at = rows[TABLE:].ravel(), 0
    taken = []
    for like in (*net.filters, *net.biases, net.out):
        taken.append(small[at : at + like.size].reshape(like.shape).copy())
        at += like.size
    n = len(WIDTHS)
    return Network(rows[:TABLE].copy(), taken[:n], taken[n : 2 * n], taken[-1], float(small[at]))


_CHANGES = "part int, task int, changes binary, tasks binary"


def _added(key: tuple, group: pa.Table) -> pa.Table:
    """The sum of a part's changes over some tasks, in the tasks' order, and how many tasks changed each row."""
    group = group.sort_by("task")
    sums = [sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column(c)) for c in ("changes", "tasks")]
    own = {c: group.column(c).slice(0, 1).combine_chunks() for c in ("part", "task")}
    return pa.table(own | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("changes", "tasks"), sums)})


def _taught(rows: DataFrame, n: int, net: Network, moments: dict, weight: dict[int, float]) -> Network:
    """The network after every task went over its rows, starting from ``net``.

    A row of parameters moves by the mean of its changes in the tasks that changed it. Tasks hold the rows of
    their hashes in a fixed order, and changes are added in the order of the tasks, so reruns agree.
    """
    shipped = rows.sparkSession.sparkContext.broadcast((net, moments))

    def work(batches):
        start, sums = shipped.value
        own = _with_parameters(start, _parameters(start))
        sums = {k: np.copy(v) for k, v in sums.items()}
        random, words = np.random.default_rng(11), Words()
        for piece in pieces(batches, "_text", TEXT_BYTES):
            if words.full():
                words = Words()
            numbered = [words.of(t) for t in piece.column("_text").to_pylist()]
            want = piece.column("_label").to_numpy().astype(np.int64)
            train(own, sums, numbered, words.table(), want, np.where(want > 0, weight[1], weight[0]), PASSES, random)
        changes = _parameters(own).astype(np.float64) - _parameters(start)
        changed = (changes != 0).any(1).astype(np.float64)
        task = TaskContext.get().partitionId()
        for part, at in enumerate(range(0, len(changes), PART)):
            if changed[at : at + PART].any():
                values = [[part], [task], [changes[at : at + PART].tobytes()], [changed[at : at + PART].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "task", "changes", "tasks"])

    dealt = rows.select("_doc", "_text", "_label").repartition(-(-n // TASK_ROWS), F.xxhash64("_doc", "_text"))
    dealt = dealt.sortWithinPartitions(F.xxhash64("_text", F.lit(3)), "_doc", "_text", "_label")
    made = dealt.select("_text", "_label").mapInArrow(work, _CHANGES)
    some = made.groupBy("part", F.expr(f"task div {FAN}")).applyInArrow(_added, _CHANGES)
    found = some.groupBy("part").applyInArrow(_added, _CHANGES).toArrow()
    moved = _parameters(net).astype(np.float64)
    for row in found.to_pylist():
        changes, tasks = np.frombuffer(row["changes"]).reshape(-1, DIM), np.frombuffer(row["tasks"])
        moved[row["part"] * PART :][: len(changes)] += changes / np.maximum(tasks, 1)[:, None]
    return _with_parameters(net, moved.astype(np.float32))


def _calibrate(net: Network, rows: DataFrame, share: float) -> None:
    """Scale and thresholds from counts of all the rows' logits; a language needs 20 rows of both classes."""
    logits = _appended(rows.select("_text", "_lang", "_label"), "_text", "_logit", net, Network.logits)
    step = F.round(F.greatest(F.least(F.col("_logit"), F.lit(float(BOUND))), F.lit(float(-BOUND))) * STEPS).cast("int").alias("_step")
    counts = logits.groupBy("_lang", "_label", step).agg(F.count("*").alias("_n")).orderBy("_lang", "_label", "_step").toArrow()
    logit, want, times = (counts.column(c).to_numpy().astype(float) for c in ("_step", "_label", "_n"))
    logit /= STEPS
    # The rows weigh as their classes occur among all labelled rows.
    prior = np.where(want > 0, share / max(1, times[want > 0].sum()), (1 - share) / max(1, times[want == 0].sum()))
    net.scale = calibrated(logit, want, prior * times * times.sum())
    score = 1 / (1 + np.exp(-np.clip(net.scale[0] * logit + net.scale[1], -30, 30)))
    langs = np.array([str(x) for x in counts.column("_lang").to_pylist()])
    known = counts.column("_lang").is_valid().to_numpy()
    for lang in sorted(set(langs[known].tolist())):
        own = known & (langs == lang)
        if min(times[own & (want > 0)].sum(), times[own & (want == 0)].sum()) >= 20:
            net.thresholds[lang] = best_threshold(score[own], want[own], times[own])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 2000, max_bytes: int = 32_768) -> Network:
    """Train on all labelled documents' whole texts, but those of every fifth hash, which calibrate.

    ``labels`` has the id and ``label`` (0, 1; others are left out). The start comes from about ``rows`` documents of each
    class with texts of at most ``max_bytes`` bytes, which bounds what reaches the driver; without such rows it is random. Ids
    without a document are left out, rows of one id are all taken. Null texts are left out, a null language has no
    threshold. Without rows of both classes the score is the share of class 1 everywhere. An empty table gives a network
    whose scores are all alike.
    """
    known = labels.where("label in (0, 1)").select(F.col(id_col).alias("_id"), F.col("label").cast("int").alias("_label"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_text is not null")
    aside = F.pmod(F.xxhash64("_doc", "_text", F.lit(5)), F.lit(5)) == 4
    # Texts travel once and need no order.
    joined = texts.join(known.hint("shuffle_hash"), F.col("_doc") == F.col("_id")).select("_doc", "_text", "_lang", "_label", aside.alias("_aside"))
    every = keep(joined, new_folder(docs.sparkSession), "labelled")
    held = {(r["_label"], r["_aside"]): r["n"] for r in every.groupBy("_label", "_aside").agg(F.count("*").alias("n")).collect()}
    n, ones = sum(held.values()), sum(v for (label, _), v in held.items() if label)
    share, net, moments = ones / max(1, n), Network.new(), {}
    if not 0 < ones < n:
        net.out[:] = 0
        net.bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return net
    weight = {0: 0.5 / (n - ones), 1: 0.5 / ones}
    taught = every.where("not _aside")
    small = sampled(taught.where(F.octet_length("_text") <= max_bytes), "_label", "_doc", rows, 9).limit(3 * rows)
    got = small.select("_doc", "_text", "_label").toArrow().sort_by([("_doc", "ascending"), ("_text", "ascending"), ("_label", "ascending")])
    want = got.column("_label").to_numpy().astype(np.int64)
    if 0 < want.sum() < len(want):
        words = Words()
        numbered = [words.of(t) for t in got.column("_text").to_pylist()]
        even = np.where(want > 0, 0.5 / want.sum(), 0.5 / (want == 0).sum())
        train(net, moments, numbered, words.table(), want, even, 6, np.random.default_rng(7))
    net = _taught(taught, n, net, moments, weight)
    _calibrate(net, every.where("_aside") if held.get((0, True)) and held.get((1, True)) else every, share)
    return net


def _appended(docs: DataFrame, text_col: str, out: str, net: Network, answers) -> DataFrame:
    """Add what ``answers`` gives for the words of each slice's texts, with the network as it was shipped."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def prepare():
        state = {"words": Words()}

        def work(texts: pa.Array) -> list[pa.Array]:
            if state["words"].full():
                state["words"] = Words()
            words = state["words"]
            numbered = [words.of(t) for t in texts.to_pylist()]
            return [pa.array(answers(shipped.value, numbered, words.table()).astype(np.float64))]

        return work

    return append(docs, text_col, f"`{out}` double", prepare, TEXT_BYTES)


def scored(docs: DataFrame, net: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every whole text, 0 to 1; null and empty texts get that of a text without words.

    Equal texts have equal scores, whatever stands beside them. A column named ``out`` is replaced, all others stay; an
    empty table stays empty.
    """
    return _appended(docs, text_col, out, net, Network.scores)


def threshold_of(net: Network, lang: Column) -> Column:
    """The language's threshold; one half where none was calibrated."""
    found = F.lit(0.5)
    for name, value in sorted(net.thresholds.items()):
        found = F.when(lang == name, F.lit(value)).otherwise(found)
    return found
