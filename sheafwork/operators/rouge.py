"""ROUGE-1/2/L/Lsum of (prediction, reference) text pairs.

A pair is scored in the row that holds it: tokens are array expressions, clipped counts of n-grams and
common subsequences one Arrow function on numbered tokens. Nothing is exploded or shuffled,
so no pair and no n-gram can make a hot task; only report means are aggregated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions.lists import ends, flat, regroup
from sheafwork.functions.scores import precision_recall_f1
from sheafwork.functions.stemming import stem
from sheafwork.functions.text import ColumnFn, rouge_tokens, split_sentences

# Report keys and score names.
KEYS = ("rouge1", "rouge2", "rougeL", "rougeLsum")
SCORES = ("fmeasure", "precision", "recall")

#: Bytes of bit rows that a walk back may hold, if they are more than its blocks need.
ROW_BYTES = 1 << 20
#: In lists longer than ``SHORT``, bit sets are kept of tokens with more positions than ``OFTEN``.
SHORT, OFTEN = 4096, 64


class _Positions:
    """token -> bit set of its positions, for the wanted tokens; 0 for all others.

    Only the sets of tokens with many positions are kept, so all of them together are no larger
    than about the list's length times the bits of ``OFTEN`` words; the others are made when asked for.
    """

    def __init__(self, tokens: Sequence[int], wanted: set[int]):
        self.sequence = tokens
        self.places: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            if token in wanted:
                self.places.setdefault(token, []).append(i)
        often = OFTEN if len(tokens) > SHORT else 0
        self.kept = {t: self._bits(p) for t, p in self.places.items() if len(p) > often}

    @staticmethod
    def _bits(places: list[int]) -> int:
        raw = bytearray(places[-1] // 8 + 1)
        for i in places:
            raw[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(raw, "little")

    def get(self, token: int) -> int:
        bits = self.kept.get(token)
        if bits is None:
            places = self.places.get(token)
            bits = self._bits(places) if places else 0
        return bits


def lcs_size(a: Sequence[int], b: Sequence[int]) -> int:
    """Length of the longest common subsequence, one table row per machine-word step.

    A row of the usual table is kept as a bit set whose zeros mark where the length grows
    (Crochemore et al. 2001, Hyyro 2004), so a step costs len(b) / word size.
    """
    if len(a) > len(b):
        a, b = b, a
    bits = _Positions(b, set(a))
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        seen = bits.get(token)
        if seen:
            row = _next_row(row, seen, full)
    return len(b) - row.bit_count()


def _next_row(row: int, seen: int, full: int) -> int:
    common = row & seen
    return ((row + common) | (row ^ common)) & full


def lcs_positions(pred: Sequence[int], ref: Sequence[int] | _Positions, row_bytes: int = ROW_BYTES) -> set[int]:
    """Reference positions on one longest common subsequence.

    Walks back from the end: equal tokens go diagonally; otherwise a step back in the
    prediction where the length grows at this reference position, else in the reference.
    The prediction is walked in blocks. Only the row ahead of each block is kept from the way
    forward; a block's own rows are made again when the walk comes to it. So there are about
    twice the square root of the prediction's length of them, or ``row_bytes`` if that is more.
    The reference may come as its positions, where they are known already.
    """
    bits = ref if isinstance(ref, _Positions) else _Positions(ref, set(pred))
    ref = bits.sequence
    full = (1 << len(ref)) - 1
    block = max(isqrt(len(pred)) + 1, row_bytes // (len(ref) // 8 + 1))
    row, ahead = full, [full]
    for start in range(0, len(pred) - block, block):
        for token in pred[start : start + block]:
            seen = bits.get(token)
            if seen:
                row = _next_row(row, seen, full)
        ahead.append(row)
    found: set[int] = set()
    i, j = len(pred) - 1, len(ref) - 1
    while ahead and j >= 0:
        row = ahead.pop()
        first = len(ahead) * block
        rows = []
        for token in pred[first : first + block]:
            seen = bits.get(token)
            if seen:
                row = _next_row(row, seen, full)
            rows.append(row)
        while i >= first and j >= 0:
            if pred[i] == ref[j]:
                found.add(j)
                i, j = i - 1, j - 1
            elif not rows[i - first] >> j & 1:
                i -= 1
            else:
                j -= 1
    return found


def union_tokens(pred_sentences: Sequence[Sequence[int]], ref_sentences: Sequence[Sequence[int]]) -> list[int]:
    """Tokens at the reference positions that any predicted sentence shares, per sentence.

    An index from token to the predicted sentences that have it names, for a reference
    sentence, those that can cover what is not yet covered, so sentences that share nothing
    never meet. Those that share most come first; one that has no uncovered token is left
    out, and a reference sentence is done once all its tokens that occur in the prediction
    are covered. A repeated predicted sentence adds nothing.
    """
    distinct = list(dict.fromkeys(map(tuple, pred_sentences)))
    wanted = frozenset(chain.from_iterable(ref_sentences))
    tokens_of = [wanted.intersection(pred) for pred in distinct]
    having: dict[int, list[int]] = {}
    for k, tokens in enumerate(tokens_of):
        for token in tokens:
            having.setdefault(token, []).append(k)
    done: dict[tuple[int, ...], list[int]] = {}
    out: list[int] = []
    for ref in map(tuple, ref_sentences):
        if ref not in done:
            places: dict[int, set[int]] = {}
            for j, token in enumerate(ref):
                if token in having:
                    places.setdefault(token, set()).add(j)
            shared = Counter(chain.from_iterable(having[token] for token in places))
            covered: set[int] = set()
            bits = _Positions(ref, set(places))
            for k, _ in shared.most_common():
                if not places:
                    break
                if tokens_of[k].isdisjoint(places):
                    continue
                for j in lcs_positions(distinct[k], bits) - covered:
                    covered.add(j)
                    places[ref[j]].discard(j)
                    if not places[ref[j]]:
                        del places[ref[j]]
            done[ref] = [ref[j] for j in sorted(covered)]
        out.extend(done[ref])
    return out


def _cut(items: list, lists: pa.Array) -> list[list]:
    """``items`` in consecutive pieces as long as the lists."""
    stops = ends(lists).tolist()
    return [items[start:stop] for start, stop in zip([0, *stops], stops)]


def _overlap(union: Sequence[int], sentences: Sequence[Sequence[int]]) -> int:
    """Tokens of the union, each as often as the sentences have it at most."""
    ours = Counter(union)
    theirs = Counter(token for sentence in sentences for token in sentence if token in ours)
    return sum(min(n, theirs[token]) for token, n in ours.items())


def gram_hits(codes: np.ndarray, pred: pa.Array, ref: pa.Array, orders: Sequence[int]) -> dict[int, np.ndarray]:
    """For each n the clipped n-gram matches of every row; ``codes`` numbers all tokens of ``pred``, then of ``ref``.

    An n-gram is numbered by its first n - 1 tokens' number and its last token. Row and number are one key; both
    sides' keys are sorted, and the runs that both have are compared.
    """
    rows = len(pred)
    own = ends(pred)
    stops = np.concatenate((own, ends(ref) + (own[-1] if rows else 0)))
    owner = np.repeat(np.arange(2 * rows), np.diff(stops, prepend=0))
    left = stops[owner] - np.arange(len(codes))
    kinds = int(codes.max(initial=0)) + 1
    grams, found = codes, {}
    for n in range(1, max(orders, default=0) + 1):
        at = np.flatnonzero(left >= n)
        if n > 1:
            _, names = np.unique(grams[at] * kinds + codes[at + n - 1], return_inverse=True)
            grams = np.zeros(len(codes), np.int64)
            grams[at] = names
        if n in orders:
            most = int(grams.max(initial=0)) + 1
            key = owner[at] % max(rows, 1) * most + grams[at]
            ours, n_ours = np.unique(key[owner[at] < rows], return_counts=True)
            theirs, n_theirs = np.unique(key[owner[at] >= rows], return_counts=True)
            both, i, j = np.intersect1d(ours, theirs, assume_unique=True, return_indices=True)
            found[n] = np.bincount(both // most, np.minimum(n_ours[i], n_theirs[j]), rows).astype(np.int64)
    return found


def token_hits(orders: Sequence[int], subsequence: bool, sentences: bool, stems: bool) -> ColumnFn:
    """``hits1``, ``hits2``, ... for the given n, ``hitsL`` and ``hitsLsum``, as far as they are asked for.

    Of the two token lists, and for ``hitsLsum`` of the two lists of sentences, which follow those if there
    are any; with nothing but sentences, a token list is its sentences in a row. The tokens of all of them are numbered together; with ``stems`` a number stands for a stem, and every
    different token of a batch is stemmed once.
    """
    plain = bool(orders) or subsequence
    names = [f"hits{n}" for n in orders] + ["hitsL"] * subsequence + ["hitsLsum"] * sentences

    @F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in names]))
    def hits(*sides: pa.Array) -> pa.Array:
        lists, nested = (sides[:2], sides[2:]) if len(sides) > 2 or not sentences else ((), sides)
        tokens = [flat(side) for side in lists] + [flat(flat(side)) for side in nested]
        coded = pa.concat_arrays(tokens).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        if stems:
            number: dict[str, int] = {}
            codes = np.array([number.setdefault(stem(w), len(number)) for w in coded.dictionary.to_pylist()], np.int64)[codes]
        parts = np.split(codes, np.cumsum([len(t) for t in tokens])[:-1])
        lists = lists or [regroup(flat(flat(side)), np.concatenate(([0], ends(flat(side))))[ends(side)]) for side in nested]
        columns: list = []
        if plain:
            columns += gram_hits(np.concatenate(parts[:2]), *lists, orders).values()
        if subsequence:
            columns.append(list(map(lcs_size, *(_cut(part.tolist(), side) for part, side in zip(parts, lists)))))
        if sentences:
            pred, ref = (_cut(_cut(part.tolist(), flat(side)), side) for part, side in zip(parts[-2:], nested))
            columns.append([_overlap(union_tokens(p, r), p) for p, r in zip(pred, ref)])
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return hits


def _order(name: str) -> int | None:
    """n of a ``rougeN`` key, None for the subsequence keys."""
    if name in ("rougeL", "rougeLsum"):
        return None
    if name.startswith("rouge") and name[5:].isdigit() and int(name[5:]) > 0:
        return int(name[5:])
    raise ValueError(f"unknown ROUGE key {name!r}")


def rouge_pairs(
    pairs: DataFrame,
    keys: Sequence[str] = KEYS,
    id_cols: Sequence[str] = ("example_id",),
    pred: str = "pred",
    ref: str = "ref",
    normalizer: ColumnFn | None = None,
    tokenizer: ColumnFn | None = None,
    use_stemmer: bool = False,
    sentences: tuple[str, str] | None = None,
) -> DataFrame:
    """Scores per pair: ``id_cols`` and ``{key}_{fmeasure,precision,recall}``.

    A normalizer or tokenizer is a ``Column -> Column`` callable. ``use_stemmer`` compares stems of
    words. ``sentences`` names columns that hold the prediction's and the reference's sentences, for
    instance by a trained splitter; without it ``rougeLsum`` cuts the texts itself.
    """

    def tokens(text: Column) -> Column:
        return rouge_tokens(text, normalizer, tokenizer)

    orders = sorted({n for n in map(_order, keys) if n})
    sides = {side: F.coalesce(F.col(text), F.lit("")) for side, text in (("p", pred), ("r", ref))}
    # Sentences are cut at white space, where the usual tokens end too; so these are a text's tokens as well.
    together = "rougeLsum" in keys and sentences is None and normalizer is None and tokenizer is None
    columns = {} if together else {f"{side}1": tokens(text) for side, text in sides.items()}
    if "rougeLsum" in keys:
        cut = {side: split_sentences(text) for side, text in sides.items()}
        if sentences is not None:
            cut = {side: F.coalesce(F.col(c), F.array().cast("array<string>")) for side, c in zip("pr", sentences)}
        columns |= {f"{side}s": F.transform(pieces, tokens) for side, pieces in cut.items()}
    rows = pairs.select(*id_cols, *[c.alias(name) for name, c in columns.items()])

    plain = bool(orders) or "rougeL" in keys
    read = ["p1", "r1"] * (plain and not together) + ["ps", "rs"] * ("rougeLsum" in keys)
    measured = {name: F.size(F.flatten(f"{side}s") if together else F.col(f"{side}1")) for name, side in (("n_pred", "p"), ("n_ref", "r"))}
    if read:
        measured["hits"] = token_hits(orders, "rougeL" in keys, "rougeLsum" in keys, use_stemmer)(*read)
    per_pair = rows.withColumns(measured)
    hits = {key: F.col("hits")[f"hits{key.removeprefix('rouge')}"] for key in keys}
    if "rougeLsum" in keys and sentences is not None:
        # a null among the sentences leaves nothing to count
        hits["rougeLsum"] = F.when(F.flatten("ps").isNotNull(), hits["rougeLsum"])

    scored_columns = []
    for key in keys:
        shorter = (_order(key) or 1) - 1  # a side has that many n-grams less than tokens
        sizes = (F.size(F.flatten("ps")), F.size(F.flatten("rs"))) if key == "rougeLsum" else (F.col("n_pred"), F.col("n_ref"))
        n_pred, n_ref = (F.greatest(n - shorter, F.lit(0)) for n in sizes)
        scored = precision_recall_f1(hits[key], n_pred, n_ref)
        scored_columns += [scored[s].alias(f"{key}_{s}") for s in SCORES]
    return per_pair.select(*id_cols, *scored_columns)


def rouge_n(pairs: DataFrame, n: int, **options) -> DataFrame:
    return rouge_pairs(pairs, keys=(f"rouge{n}",), **options)


def rouge_l(pairs: DataFrame, **options) -> DataFrame:
    return rouge_pairs(pairs, keys=("rougeL",), **options)


def rouge_lsum(pairs: DataFrame, **options) -> DataFrame:
    return rouge_pairs(pairs, keys=("rougeLsum",), **options)


def score_columns(keys: Sequence[str] = KEYS) -> list[str]:
    return [f"{key}_{s}" for key in keys for s in SCORES]


def rouge_multi_ref(
    pairs: DataFrame,
    accumulate: str = "best",
    keys: Sequence[str] = KEYS,
    id_col: str = "example_id",
    ref_col: str = "ref_id",
    **options,
) -> DataFrame:
    """One row per prediction over its references.

    ``best`` takes all scores of the reference with the largest F of the first key, ties
    to the lowest reference id; ``avg`` takes means. Both combine map-side, so a
    prediction with very many references is no hot group.
    """
    if accumulate not in ("best", "avg"):
        raise ValueError(f"accumulate must be 'best' or 'avg', not {accumulate!r}")
    scored = rouge_pairs(pairs, keys, id_cols=(id_col, ref_col), **options)
    columns = score_columns(keys)
    if accumulate == "avg":
        return scored.groupBy(id_col).agg(*[F.avg(c).alias(c) for c in columns])
    rank = F.struct(F.col(f"{keys[0]}_fmeasure"), -F.col(ref_col))
    return scored.groupBy(id_col).agg(F.max_by(F.struct(*columns), rank).alias("best")).select(id_col, "best.*")


def rouge_report(pairs: DataFrame, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """Unweighted mean over pairs of every score."""
    return rouge_pairs(pairs, keys, **options).agg(*[F.avg(c).alias(c) for c in score_columns(keys)])
