"""Token-id array expressions: specials, truncation, padding, masks, label shifts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: label id that the loss skips.
IGNORE = -100


def ints(values) -> Column:
    """Literal ``array<int>``, also for an empty list."""
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def repeat(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), F.greatest(n, F.lit(0)).cast("int"))


def add_special_tokens(ids: Column, begin: int | None, end: int | None) -> Column:
    return F.concat(ints([] if begin is None else [begin]), ids, ints([] if end is None else [end]))


def add_pair_special_tokens(a: Column, b: Column, begin: int, sep: int, end: int, seps: int = 1) -> Column:
    """begin a sep b end; ``seps=2`` gives the four-special template."""
    return F.concat(ints([begin]), a, ints([sep] * seps), b, ints([end]))


def truncate(ids: Column, max_len: int, specials: int = 0) -> Column:
    return F.slice(ids, 1, max(max_len - specials, 0))


def pair_cuts(len_a: Column, len_b: Column, budget: int) -> Column:
    """Lengths kept by longest-first truncation, as struct(a, b).

    First shorten the longer side to the shorter one, then share what is still over
    the budget, the odd id coming off ``b``.
    """
    over = F.greatest(len_a + len_b - F.lit(budget), F.lit(0))
    cut_a = F.least(over, F.greatest(len_a - len_b, F.lit(0)))
    cut_b = F.least(over, F.greatest(len_b - len_a, F.lit(0)))
    rest = over - cut_a - cut_b
    return F.struct(
        (len_a - cut_a - F.floor(rest / 2)).cast("int").alias("a"),
        (len_b - cut_b - F.ceil(rest / 2)).cast("int").alias("b"),
    )


def truncate_pair(a: Column, b: Column, budget: int) -> Column:
    keep = pair_cuts(F.size(a), F.size(b), budget)
    return F.struct(F.slice(a, F.lit(1), keep["a"]).alias("a"), F.slice(b, F.lit(1), keep["b"]).alias("b"))


def _padded(values: Column, fill: Column, side: str) -> Column:
    if side not in ("left", "right"):
        raise ValueError(f"side must be 'left' or 'right', not {side!r}")
    return F.concat(fill, values) if side == "left" else F.concat(values, fill)


def pad_by(ids: Column, pads: Column, pad: int, side: str = "right") -> Column:
    return _padded(ids, repeat(pad, pads), side)


def pad_to(ids: Column, length: Column | int, pad: int, side: str = "right") -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return pad_by(ids, length - F.size(ids), pad, side)


def attention_mask(n_real: Column, length: Column | int, side: str = "right") -> Column:
    """Ones on real ids by count, never by value: the pad id may be a real id too."""
    length = F.lit(length) if isinstance(length, int) else length
    return _padded(repeat(1, n_real), repeat(0, length - n_real), side)


def token_type_ids(n_first: Column, n_second: Column, length: Column | int) -> Column:
    """0 over the first segment with its specials, 1 over the second, 0 over pads."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(repeat(0, n_first), repeat(1, n_second), repeat(0, length - n_first - n_second))


def mask_pad_labels(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(IGNORE)).otherwise(x))


def mask_labels_by_mask(ids: Column, mask: Column) -> Column:
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 0, F.lit(IGNORE)).otherwise(x))


def unmask_labels(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == IGNORE, F.lit(pad)).otherwise(x))


def append_suffix(ids: Column, suffix: Column) -> Column:
    """The suffix goes after the pads, at the same place in every row."""
    return F.concat(ids, suffix)


def extend_mask(mask: Column, n: Column) -> Column:
    return F.concat(mask, repeat(1, n))


def join_sequences(first: Column, second: Column) -> Column:
    return F.concat(first, second)


def shift_targets(labels: Column) -> Column:
    """Next-token targets; the last one is ignored, an empty row stays empty."""
    shifted = F.concat(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), ints([IGNORE]))
    return F.when(F.size(labels) > 0, shifted).otherwise(ints([]))


def last_real_index(ids: Column, pad: int, side: str = "right") -> Column:
    """Zero-based index of the last non-pad id, -1 if there is none.

    ``right`` counts the non-pad ids, which is exact for right padding with a pad id
    that no real token shares; ``left`` gives the last index of a left-padded row.
    """
    real = F.size(F.filter(ids, lambda x: x != pad))
    if side == "left":
        return F.when(real > 0, F.size(ids) - 1).otherwise(F.lit(-1))
    return real - 1


def pick_at(values: Column, index: Column) -> Column:
    return F.get(values, index)


def multi_hot(targets: Column, num_labels: int) -> Column:
    """Dense float vector; repeats collapse, ids outside the range fall away."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(num_labels - 1)),
        lambda i: F.when(F.array_contains(targets, i), F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"),
    )


def sequence_length(ids: Column) -> Column:
    return F.size(ids)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, also where a lambda reads it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def repeats(values: Column) -> Column:
    """One tag per second and later occurrence of a string: the string and its number.

    Sorted, equal strings stand together; a run from one start to the next has as many
    occurrences as its length. Linear after the sort.
    """

    def of_sorted(ordered: Column) -> Column:
        starts = F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i))

        def of_runs(start: Column) -> Column:
            def later(at: Column, k: Column) -> Column:
                length = F.coalesce(F.get(start, k + 1), F.size(ordered)) - at
                tag = F.transform(
                    F.sequence(F.lit(2), length),
                    lambda j: F.concat(F.get(ordered, at), F.lit("\u0001"), j.cast("string")),
                )
                return F.when(length > 1, tag)

            return F.flatten(F.array_compact(F.transform(start, later)))

        return bind(F.array_compact(starts), of_runs)

    return bind(F.sort_array(values), of_sorted)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum over distinct strings of the smaller of the two counts.

    Every common string counts once, and every number of repeat that both sides reach once
    more. Both intersections are hash based.
    """
    return F.size(F.array_intersect(a, b)) + F.size(F.array_intersect(repeats(a), repeats(b)))
