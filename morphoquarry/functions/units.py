"""Reading of unit spellings, scaling texts and remarks; plain Python, run over distinct texts or small tables."""

from __future__ import annotations

import ast
import json
import re
import unicodedata

# Base units with their length in picometres (0: pixels) and their usual names.
UNITS = {
    "nm": (1_000.0, ["nm", "nanometer", "nanometre", "nanometers", "nanometres"]),
    "um": (1_000_000.0, ["um", "micron", "microns", "micrometer", "micrometre", "micrometers", "micrometres", "mikrometer", "mikron"]),
    "mm": (1_000_000_000.0, ["mm", "millimeter", "millimetre", "millimeters", "millimetres"]),
    "cm": (10_000_000_000.0, ["cm", "centimeter", "centimetre", "zentimeter"]),
    "m": (1_000_000_000_000.0, ["m", "meter", "metre", "meters", "metres"]),
    "px": (0.0, ["px", "pixel", "pixels", "pix", "vox", "voxel", "voxels"]),
}
ALIASES = [(alias, unit, pm) for unit, (pm, names) in UNITS.items() for alias in names]

_POWER_WORDS = re.compile(r"^(square|sq\.?|quadrat|cubic|cu\.?|kubik)\s*(?=\w)")
_POWER_TAIL = re.compile(r"\s*(?:\^|\*\*)?\s*([23])$")


def split_unit(spelling: str | None) -> tuple[str, int]:
    """A spelling as (base, power): ``' sq. Micron'`` is ('micron', 2). The power is 1 if none is told."""
    text = unicodedata.normalize("NFKC", spelling or "").casefold().replace("μ", "u").replace("µ", "u").strip().strip(".")
    power = 1
    if tail := _POWER_TAIL.search(text):
        power, text = int(tail[1]), text[: tail.start()]
    if head := _POWER_WORDS.match(text):
        power, text = (2 if head[1][0] in "sq" else 3), text[head.end() :]
    return re.sub(r"[\s.]+", "", text), power


def edit_distance(a: str, b: str) -> float:
    """Edits that turn a into b: 1 for a letter, ½ for a vowel, a doubled letter or two neighbours swapped."""
    soft = set("aeiouy")
    cost = lambda c, before: 0.5 if c in soft or c == before else 1.0
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and not j:
                continue
            best = float("inf")
            if i:
                best = rows[i - 1][j] + cost(a[i - 1], a[i - 2] if i > 1 else "")
            if j:
                best = min(best, rows[i][j - 1] + cost(b[j - 1], b[j - 2] if j > 1 else ""))
            if i and j:
                same = a[i - 1] == b[j - 1]
                best = min(best, rows[i - 1][j - 1] + (0 if same else 0.5 if a[i - 1] in soft and b[j - 1] in soft else 1))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 0.5)
            rows[i][j] = best
    return rows[-1][-1]


def close_enough(base: str, alias: str) -> float | None:
    """The distance if base may stand for alias: short names must be met exactly, longer ones within a fifth of their length."""
    if base == alias:
        return 0.0
    if min(len(base), len(alias)) < 4:
        return None
    d = edit_distance(base, alias)
    return d if d <= len(alias) / 5 else None


_NUMBER = r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
_WORD = r"[A-Za-zµμ²³^]+"
_BY_AXIS = re.compile(rf"\b([XYZ])\s*[=: ]\s*({_NUMBER})\s*({_WORD})?(?:\s*/\s*({_WORD}))?")
_NAMED_AFTER = re.compile(rf"({_NUMBER})\s*({_WORD})(?:\s*/\s*({_WORD}))?\s*\(([XYZ]+)\)")
_PER = re.compile(rf"({_NUMBER})\s*(px|pixels?|vox|voxels?)\s*/\s*({_WORD})\s+in\s+([XYZ](?:\s*(?:,|and)\s*[XYZ])*)", re.I)
_STEP = re.compile(rf"\b([XYZ])[- ]?step\s*[=:]?\s*({_NUMBER})\s*({_WORD})?", re.I)
_TIMES = re.compile(rf"({_NUMBER}(?:\s*[x×*]\s*{_NUMBER})+)\s*({_WORD})?\s*\(([XYZ](?:\s*[x×*,]?\s*[XYZ])*)\)")


def _number(text) -> float | None:
    try:
        value = float(str(text).replace(",", "."))
    except ValueError:
        return None
    return value if value == value and abs(value) != float("inf") else None


def _valued(entry) -> tuple[float, str | None] | None:
    """A number with its unit, from a number, a text as '2.5E-07 m', or an object with value and unit."""
    if entry is None or isinstance(entry, bool):
        return None
    if isinstance(entry, dict):
        value = _valued(entry.get("value"))
        return value and (value[0], entry.get("unit") or value[1])
    if isinstance(entry, (int, float)):
        value = _number(entry)
        return None if value is None else (value, None)
    found = re.match(rf"\s*({_NUMBER})\s*({_WORD})?\s*$", str(entry))
    if not found or (value := _number(found[1])) is None:
        return None
    return value, found[2]


def parse_scaling(text: str | None) -> dict[str, tuple[float, str | None, bool]]:
    """Axis → (number, unit or None, inverse); inverse: the number counts pixels per unit. Texts without a reading give {}."""
    out: dict[str, tuple[float, str | None, bool]] = {}
    text = unicodedata.normalize("NFKC", text or "").strip()
    if text.startswith("{"):
        tree = None
        for read in (json.loads, ast.literal_eval):
            try:
                tree = read(text)
                break
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
        if isinstance(tree, dict):
            for axis, entry in tree.items():
                value = _valued(entry)
                if value and str(axis).strip().upper() in ("X", "Y", "Z"):
                    out[str(axis).strip().upper()] = (*value, False)
            return out
    for found in _PER.finditer(text):
        for axis in re.findall("[XYZ]", found[4].upper().replace("AND", "")):
            out[axis] = (_number(found[1]), found[3], True)
    for found in _STEP.finditer(text):
        out.setdefault(found[1].upper(), (_number(found[2]), found[3], False))
    for found in _NAMED_AFTER.finditer(text):
        for axis in found[4]:
            out.setdefault(axis, (_number(found[1]), found[2], False))
    for found in _TIMES.finditer(text):
        for axis, number in zip(re.findall("[XYZ]", found[3]), re.findall(_NUMBER, found[1])):
            out.setdefault(axis, (_number(number), found[2], False))
    if not out:
        units = [f[3] for f in _BY_AXIS.finditer(text) if f[3]]
        for found in _BY_AXIS.finditer(text):
            out.setdefault(found[1], (_number(found[2]), found[3] or (units[-1] if units else None), False))
    return {axis: entry for axis, entry in out.items() if entry[0] is not None}


_CLAUSE = re.compile(r"[;|\n]+|\.\s+|\.$")
_ABOUT_SIZE = re.compile(r"\b(areas?|sizes?|volumes?|fläche\w*|volumen|größe\w*)\b", re.I)
_ABOUT_PLACE = re.compile(r"\b(centroids?|schwerpunkte?|zentroide?n?)\b", re.I)
_UNIT_TAIL = re.compile(r"\b(?:in|as|is|are|holds?)\s+((?:(?:square|cubic|sq\.?|cu\.?)\s+)?[^\W\d_]+(?:\^?[23²³])?)\s*$", re.I)
_COUNTED = re.compile(r"\d\s*[^\W\d_]+(?:\^?[23²³])?\s*$")


def parse_notes(text: str | None) -> tuple[str | None, str | None]:
    """(unit of areas, unit of centroids) told by a remark; sizes of other things, as '40 µm' of thickness, tell neither."""
    size = place = None
    for clause in _CLAUSE.split(text or ""):
        clause = clause.strip(" \t.")
        told = _UNIT_TAIL.search(clause)
        if not told or _COUNTED.search(clause):
            continue
        if _ABOUT_PLACE.search(clause):
            place = place or told[1]
        elif _ABOUT_SIZE.search(clause):
            size = size or told[1]
    return size, place
