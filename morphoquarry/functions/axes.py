"""Axis formats of arrays, unit factors, and small matching helpers, driver-side."""

from __future__ import annotations

#: Canonical order: sample, time, channel, z, y, x.
ORDER = "STCZYX"
#: Micrometres per unit.
MICROMETRES = {"m": 1e6, "mm": 1e3, "um": 1.0, "nm": 1e-3}


def estimate_format(shape: tuple[int, ...], channel_max: int = 4) -> str:
    """The likely axes of an array's shape: the two largest neighbours are Y and X, a short axis is a channel, others Z, then T, then S.

    (3, 1024, 1024) is read as CYX. Shapes of fewer than two or more than six axes raise ValueError.
    """
    n = len(shape)
    if not 2 <= n <= 6:
        raise ValueError(f"no format for {n} axes")
    at = max(range(n - 1), key=lambda i: (shape[i] * shape[i + 1], i))
    out = [""] * n
    out[at], out[at + 1] = "Y", "X"
    rest = [i for i in range(n) if not out[i]]
    for i in reversed(rest):
        if 1 < shape[i] <= channel_max and "C" not in out:
            out[i] = "C"
    for i in reversed([i for i in rest if not out[i]]):
        out[i] = next(a for a in "ZTSC" if a not in out)
    return "".join(out)


def to_canonical(axes: str, order: str = ORDER) -> list[int]:
    """The permutation that brings axes, by name, to the canonical order."""
    return [axes.index(a) for a in order if a in axes]


def without(axes: str, drop: str) -> str:
    return "".join(a for a in axes if a not in drop)


def unit_factor(sizes_um: dict[str, float], axes: str) -> float:
    """Units of a product over these axes, as µm² per pixel for YX."""
    out = 1.0
    for a in axes:
        out *= sizes_um[a]
    return out


def greedy_pairs(a: list[float], b: list[float]) -> list[tuple[int, int]]:
    """One-to-one pairs (index in a, index in b), each a's nearest number that is left, in order of a; ties go to the earlier."""
    left, out = list(range(len(b))), []
    for i, v in enumerate(a):
        if not left:
            break
        j = min(left, key=lambda k: (abs(b[k] - v), k))
        left.remove(j)
        out.append((i, j))
    return out
