"""Runs of stages: each takes and returns named DataFrames; nothing is computed until a result is written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

Data = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """``execute`` adds or replaces tables; ``compile`` gives result tables. Names in ``after`` and ``before`` order stages where both run; ``blocks`` names stages whose compile this one stands in for."""

    name: str
    execute: Callable[[Data], Data]
    compile: Callable[[Data], Data] | None = None
    needs: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    blocks: tuple[str, ...] = field(default_factory=tuple)


def ordered(stages: list[Stage]) -> list[Stage]:
    """Topological order; among those that may come next, the first by name. A circle raises ValueError."""
    by = {s.name: s for s in stages}
    if len(by) != len(stages):
        raise ValueError("two stages have the same name")
    graph = TopologicalSorter({n: {a for a in s.after if a in by} for n, s in by.items()})
    for n, s in by.items():
        for later in s.before:
            if later in by:
                graph.add(later, n)
    try:
        graph.prepare()
    except CycleError as e:
        raise ValueError(f"stages wait for each other: {sorted(set(e.args[1]))}") from None
    out, waiting = [], []
    while graph.is_active():
        waiting = sorted([*waiting, *graph.get_ready()])
        out.append(by[waiting[0]])
        graph.done(waiting.pop(0))
    return out


def run(stages: list[Stage], data: Data) -> tuple[Data, Data]:
    """(tables after all stages, results). All missing tables are told at once, before anything runs."""
    line = ordered(stages)
    blocked = {n for s in line for n in s.blocks}
    tables, results, missing = dict(data), {}, []
    have = set(data)
    for s in line:
        missing += [f"{s.name} needs {n}" for n in s.needs if n not in have and not any(n == o.name for o in line)]
    if missing:
        raise KeyError("; ".join(missing))
    for s in line:
        tables |= s.execute(tables)
    for s in line:
        if s.compile and s.name not in blocked:
            results |= s.compile(tables)
    return tables, results
