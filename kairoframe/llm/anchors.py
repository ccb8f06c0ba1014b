"""Anchors: places in byte strings that equal stretches of text choose alike (minimizers of hashed k-grams)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from kairoframe.llm.bytetext import RangeHash, gram_hashes, mix

GRAM = 12


class Anchors(NamedTuple):
    """Of each anchor: its text, its place, and the first and last of the windows that it stands for, counted from the start of all bytes."""

    text: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, choice: int) -> Anchors:
    """Every string of ``length`` bytes inside a text is a window; its anchor is the leftmost of the smallest k-gram hashes among its first
    ``choice`` places. So two equal windows have their anchors at the same place in them."""
    n = int(offsets[-1])
    if n < length:
        return Anchors(*(np.zeros(0, np.int64),) * 4)
    last = n - GRAM + 1
    gram = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    gram[:last] = gram_hashes(raw[:n], GRAM)
    # The minimum over [i, i + choice) by doubling; the leftmost of equal ones, so places are carried along.
    best = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
    width = 1
    while width < choice:
        step = min(width, choice - width)
        other = best[step:]
        here = best[: n - step]
        take = gram[other] < gram[here]
        best = np.concatenate([np.where(take, other, here), best[n - step :]])
        width += step
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    start = offsets[text] + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = best[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    after = np.append(first[1:], len(start)) - 1
    return Anchors(text[first], place[first], start[first], start[after])


def keys(hashed: RangeHash, a: Anchors, length: int, choice: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor: the hash of the bytes after it that all its windows hold, and that of all bytes that its windows cover, together
    with the anchor's place among them."""
    prefix = hashed(a.place, a.place + (length - choice + 1))
    whole = hashed(a.low, a.high + length)
    return prefix, mix(whole + mix(((a.place - a.low) * np.int64(65_536) + (a.high - a.low)).astype(np.uint64)))
