"""Content-defined phrases of byte strings: the numpy side of prefix-free parsing."""

from __future__ import annotations

import numpy as np

#: Bytes of the rolling hash that triggers phrases.
GRAM = 16
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
#: Bytes of a text that are parsed at a time.
PIECE = 1 << 20


def _powers(n):
    up = np.empty(n, np.uint64)
    up[0] = 1
    with np.errstate(over="ignore"):
        up[1:] = np.uint64(_BASE)
        return np.multiply.accumulate(up)


_UP = _powers(PIECE + 1024)


def _inverse():
    x = 1
    for _ in range(6):
        x = x * (2 - _BASE * x) % (1 << 64)
    return x


def _down(n):
    down = np.full(n, _inverse(), np.uint64)
    down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(down)


_DOWN = _down(PIECE + 1024)


def rolling(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A 32-bit hash of every ``width`` bytes, from differences of one running sum."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
        n = len(data) - width + 1
        grams = (sums[width:] - sums[:-width]) * _DOWN[:n]
        return (grams ^ (grams >> np.uint64(29))) * np.uint64(_MIX) >> np.uint64(32)


def triggers(data: np.ndarray, window: int) -> np.ndarray:
    """For every window of ``window`` bytes the place of its trigger, a gram with the least hash.

    The trigger is searched among the first ``window - 40`` grams, the last of equals
    wins. So it depends on the window's own bytes only: equal windows have equal
    triggers, and at least 41 of their bytes follow the trigger.
    """
    reach = window - 40
    grams = rolling(data)
    keys = (grams << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    size, least = 1, keys
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
    n = len(data) - window + 1
    return (np.uint64(0xFFFFFFFF) - (least[:n] & np.uint64(0xFFFFFFFF))).astype(np.int64)


def parse(data: np.ndarray, window: int):
    """(first, last, trigger) of each phrase: the windows that start in first..last share a trigger.

    The phrase's string runs from ``first`` to ``last + window``: phrases overlap by a
    window, as in prefix-free parsing, so each window is a prefix of a suffix of one phrase.
    """
    n = len(data) - window + 1
    starts, lasts, places, at = [], [], [], 0
    while at < n:
        part = data[at : at + PIECE]
        found = triggers(part, window) + at
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        first = np.concatenate(([0], cuts)) + at
        last = np.concatenate((cuts - 1, [len(found) - 1])) + at
        starts.append(first)
        lasts.append(last)
        places.append(found[first - at])
        at += len(found)
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(lasts), np.concatenate(places)
