"""Helpers inside Arrow functions: list arrays as flat values and lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(lists: pa.Array) -> pa.Array:
    """All elements in order; an empty result is made anew, as one from the JVM may lack its buffers."""
    values = lists.flatten()
    return values if len(values) else pa.array([], values.type)


def ends(lists: pa.Array) -> np.ndarray:
    """Running end of each list in the flat values; a null list has no element."""
    return np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


def regroup(values: pa.Array, list_ends, nulls: pa.Array | None = None) -> pa.ListArray:
    """List array over flat ``values``."""
    offsets = pa.array(np.concatenate(([0], list_ends)), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=nulls)


def packed(numbers: pa.Array, list_ends, nulls: pa.Array | None = None) -> pa.Array:
    """Lists of 32-bit numbers as bytes: for each list which elements are valid, then all first bytes, all second ones and so on.

    Equal bytes stand together, so the bytes of a shuffle compress to about half of those of int lists.
    """
    stops = np.asarray(list_ends, np.int64)
    sizes = np.diff(stops, prepend=0)
    raw = pc.fill_null(numbers, 0).to_numpy(zero_copy_only=False).astype("<i4").view(np.uint8).reshape(-1, 4)
    valid = numbers.is_valid().to_numpy(zero_copy_only=False)
    at, step = np.arange(len(raw)) + np.repeat(4 * (stops - sizes), sizes), np.repeat(sizes, sizes)
    data = np.empty(5 * len(raw), np.uint8)
    for k, plane in enumerate((valid, *raw.T)):
        data[at + k * step] = plane
    offsets = pa.py_buffer(np.concatenate(([0], 5 * stops)).astype(np.int32))
    out = pa.Array.from_buffers(pa.binary(), len(stops), [None, offsets, pa.py_buffer(data)])
    return out if nulls is None else pc.if_else(nulls, pa.scalar(None, pa.binary()), out)


def unpacked(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of :func:`packed` lists, or of list arrays, and the running end of each list."""
    if pa.types.is_list(lists.type) or pa.types.is_large_list(lists.type):
        return flat(lists), ends(lists)
    sizes = pc.fill_null(pc.binary_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 5
    stops = np.cumsum(sizes)
    if not sizes.sum():
        return pa.array([], pa.int32()), stops
    lists = lists.cast(pa.large_binary())
    _, offsets, data = lists.buffers()
    starts = np.frombuffer(offsets, np.int64)[lists.offset : lists.offset + len(lists)]
    at = np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1])
    step, data = np.repeat(sizes, sizes), np.frombuffer(data, np.uint8)
    raw = np.stack([data[at + k * step] for k in range(1, 5)], axis=1)
    return pa.array(raw.view("<i4").ravel(), mask=data[at] == 0), stops


def byte_lengths(strings: pa.Array) -> np.ndarray:
    return pc.binary_length(strings).to_numpy(zero_copy_only=False)


def string_hashes(strings: pa.Array, longest: int) -> np.ndarray:
    """64-bit hashes of the first ``longest`` bytes of each string and its length; there are no nulls."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    sizes = byte_lengths(strings)
    hashed = sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    if data is None or not len(strings):
        return hashed
    raw = np.frombuffer(data, np.uint8)
    starts = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings)]
    # Longest first, so the strings that have a byte at a place come before all others.
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, h = starts[order], -sizes[order], hashed[order]
    for at in range(min(longest, -int(sizes[0]))):
        n = int(np.searchsorted(sizes, -at, side="left"))
        h[:n] = (h[:n] ^ raw[starts[:n] + at]) * np.uint64(0xBF58476D1CE4E5B9)
        h[:n] ^= h[:n] >> np.uint64(31)
    hashed[order] = h
    return hashed
