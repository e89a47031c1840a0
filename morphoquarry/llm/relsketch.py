"""A mergeable quantile sketch of relative-rank compactors.

Each level holds values that stand for 2^level values. A full level sorts its values, keeps those nearest to the
protected tail, and passes every other one of the rest on; how much of the rest takes part follows the number of
compactions before, so values far from the tail are compacted often and those near it rarely. The error of a rank is
then in proportion to its distance from the protected end.
"""

from __future__ import annotations

import math
import struct

import numpy as np

START_SECTIONS = 3
LEAST_SECTION = 4
_HEAD, _LEVEL = struct.Struct("<HBqH"), struct.Struct("<qIfBI")


def is_plain(data: bytes) -> bool:
    """Whether a dump holds all its values as they came."""
    return _HEAD.unpack_from(data)[3] == 1 and _LEVEL.unpack_from(data, _HEAD.size)[0] == 0


def other_side(data: bytes) -> bytes:
    """A plain dump, as the sketch that protects the other tail would have it."""
    k, high, n, _ = _HEAD.unpack_from(data)
    at = _HEAD.size + _LEVEL.size
    return _HEAD.pack(k, not high, n, 1) + data[_HEAD.size : at] + (-np.frombuffer(data, "<f8", -1, at)).tobytes()


def dumped(values: np.ndarray, k: int, high: bool) -> bytes:
    """What a new sketch dumps after these numbers, none of them NaN; few values need no sketch for that."""
    if len(values) > 2 * START_SECTIONS * max(LEAST_SECTION, 2 * round(k / 2)):
        return RelSketch(k, high).update(values).dump()
    signed = values if high else -values
    return _HEAD.pack(k, high, len(values), 1) + _LEVEL.pack(0, START_SECTIONS, k, 0, len(values)) + signed.astype("<f8").tobytes()


class _Level:
    __slots__ = ("values", "state", "sections", "width", "coin")

    def __init__(self, k: int):
        self.values, self.state, self.sections, self.width, self.coin = np.zeros(0), 0, START_SECTIONS, float(k), 0

    @property
    def section(self) -> int:
        return max(LEAST_SECTION, 2 * round(self.width / 2))

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.section

    def compact(self, rng: np.random.Generator) -> np.ndarray:
        values = np.sort(self.values)  # ascending: the end of the array is the protected one
        trailing = (~self.state & (self.state + 1)).bit_length() - 1
        part = min(trailing + 1, self.sections)
        safe = self.sections * self.section + (self.sections - part) * self.section
        upto = len(values) - safe
        upto -= upto % 2
        self.coin = 1 - self.coin if self.state % 2 else int(rng.integers(2))
        passed, self.values = values[self.coin : upto : 2], values[upto:]
        self.state += 1
        if self.state >= 1 << (self.sections - 1) and self.width > LEAST_SECTION * math.sqrt(2):
            self.width /= math.sqrt(2)
            self.sections *= 2
        return passed


class RelSketch:
    """Counts below about 6·k values are exact. ``high``: the upper tail is the protected one, else the lower."""

    def __init__(self, k: int = 32, high: bool = True):
        self.k, self.high, self.n = k, high, 0
        self.levels: list[_Level] = [_Level(k)]
        self._rng = np.random.default_rng(k)

    def update(self, values: np.ndarray) -> "RelSketch":
        """Adds numbers; NaN isn't one."""
        values = values[~np.isnan(values)]
        return self._take(values if self.high else -values)

    def _take(self, signed: np.ndarray) -> "RelSketch":
        self.n += len(signed)
        room = 4096
        for at in range(0, len(signed), room):
            self._add(0, signed[at : at + room])
            self._shrink()
        return self

    def _add(self, level: int, values: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append(_Level(self.k))
        self.levels[level].values = np.concatenate([self.levels[level].values, values])

    def _shrink(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level].values) > self.levels[level].capacity:
                self._add(level + 1, self.levels[level].compact(self._rng))
            level += 1

    def merge(self, other: "RelSketch") -> "RelSketch":
        self.n += other.n
        for h, level in enumerate(other.levels):
            self._add(h, level.values)
            mine = self.levels[h]
            mine.state |= level.state
            if level.sections > mine.sections:
                mine.sections, mine.width = level.sections, level.width
        self._shrink()
        return self

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """For each share q the smallest kept value whose estimated rank is at least q·n; NULL of an empty sketch."""
        if not self.n:
            return [None] * len(shares)
        values = np.concatenate([x.values for x in self.levels])
        weights = np.concatenate([np.full(len(x.values), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        if not self.high:
            values = -values
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.maximum(np.ceil(np.array(shares) * ranks[-1] - 1e-9), 1), "left")
        return [float(values[order[min(i, len(order) - 1)]]) for i in at]

    def rank_error(self, share: float, deviations: float = 3.0) -> float:
        """The bound of a rank's error as a share of n, at so many standard deviations; 0 while nothing was compacted."""
        if len(self.levels) == 1:
            return 0.0
        end = 1 - share if self.high else share
        relative = math.sqrt(0.0512 / START_SECTIONS) / self.k * end
        return deviations * min(relative, 0.084 / self.k)

    def dump(self) -> bytes:
        head = _HEAD.pack(self.k, self.high, self.n, len(self.levels))
        parts = [_LEVEL.pack(x.state, x.sections, x.width, x.coin, len(x.values)) + x.values.astype("<f8").tobytes() for x in self.levels]
        return head + b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> "RelSketch":
        k, high, n, count = _HEAD.unpack_from(data)
        out, at = cls(k, bool(high)), _HEAD.size
        out.n, out.levels = n, []
        for _ in range(count):
            level = _Level(k)
            level.state, level.sections, level.width, level.coin, size = _LEVEL.unpack_from(data, at)
            at += _LEVEL.size
            level.values = np.frombuffer(data, "<f8", size, at).copy()
            at += 8 * size
            out.levels.append(level)
        return out

    @classmethod
    def combined(cls, dumps: list[bytes]) -> "RelSketch":
        """All of them merged; the values of those that never compacted are taken together."""
        whole, plain = [], []
        for data in dumps:
            if is_plain(data):
                plain.append(np.frombuffer(data, "<f8", -1, _HEAD.size + _LEVEL.size))
            else:
                whole.append(data)
        k, high, _, _ = _HEAD.unpack_from(dumps[0])
        out = cls.load(whole[0]) if whole else cls(k, bool(high))
        for data in whole[1:]:
            out.merge(cls.load(data))
        return out._take(np.concatenate(plain)) if plain else out
