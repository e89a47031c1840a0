"""Nested JSON records to flat tables that keep parent and child links: one visit per record, tagged rows, schemas by tag."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGGED = "tag string, record long, pk string, parent string, pos long, at_key string, payload string"


@dataclass(frozen=True)
class Node:
    """A kind of element: where it is found below its parent, and what is kept of it.

    ``path``: keys from the parent's element. ``each``: the value is a list, an object of numbered entries, or a lone
    element. ``position``: gives the position from (order, key, element). ``keep``: gives the payload, JSON-ready.
    ``children``: kinds below it.
    """

    tag: str
    path: tuple[str, ...]
    keep: Callable[[object], object]
    position: Callable[[int, str | None, object], int | None] = lambda order, key, element: int(key) if key is not None and key.isdigit() else order
    scalars: bool = False
    lists: bool = False
    children: tuple["Node", ...] = field(default_factory=tuple)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def read_json(text: str | None):
    """The value of a valid JSON text, else None. NaN and Infinity aren't valid."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (TypeError, ValueError, RecursionError):
        return None


def opened(value):
    """Text that holds a JSON object or list counts as that."""
    for _ in range(3):
        if not isinstance(value, str) or value.lstrip()[:1] not in ("{", "[", '"'):
            break
        inner = read_json(value)
        if not isinstance(inner, (dict, list, str)):
            break
        value = inner
    return value


def _elements(value, node: Node) -> Iterator[tuple[int, str | None, object]]:
    """(order, key, element) of what stands at a node's place. NULL, empty and unfit elements are none, but keep their place in the count."""
    value = opened(value)
    if isinstance(value, dict):
        numbered = value and all(k.isdigit() for k in value)
        entries = [(i, k, v) for i, (k, v) in enumerate(value.items())] if numbered else [(0, None, value)]
    elif isinstance(value, list):
        lone = node.lists and value and not any(isinstance(opened(v), (list, dict)) for v in value if v is not None)
        entries = [(0, None, value)] if lone else [(i, None, v) for i, v in enumerate(value)]
    elif value is None:
        entries = []
    else:
        entries = [(0, None, value)]
    for order, key, element in entries:
        element = opened(element) if not node.scalars or isinstance(element, (dict, list)) else element
        if isinstance(element, dict) and element and not node.lists:
            yield order, key, element
        elif isinstance(element, list) and element and node.lists:
            yield order, key, element
        elif node.scalars and isinstance(element, (str, int, float)) and not isinstance(element, bool) and element != "":
            yield order, key, element


def _visit(record: int, value, node: Node, parent: str, out: list) -> None:
    stack = [(value, node, parent)]
    while stack:
        value, node, parent = stack.pop()
        for step in node.path:
            value = opened(value)
            value = value.get(step) if isinstance(value, dict) else None
        for order, key, element in _elements(value, node):
            pos = node.position(order, key, element)
            if pos is None:
                continue
            pk = f"{parent}/{node.tag}:{pos}" if node.path or parent else f"{record}"
            out.append((node.tag, record, pk, parent, pos, key, json.dumps(node.keep(element), ensure_ascii=False)))
            for child in reversed(node.children):
                stack.append((element, child, pk))


def tagged(df: DataFrame, record_col: str, json_col: str, tree: tuple[Node, ...]) -> DataFrame:
    """Rows (tag, record, pk, parent, pos, at_key, payload) of all elements, in one visit per record.

    A record that is NULL or no valid JSON object gives none, and neither do rows with a NULL id. A record logged more
    than once comes out once; where its texts differ, an element of more than one takes the values first in order.
    ``pk`` spells the way from the record, so a child's ``parent`` is its parent's ``pk``. Only elements are shuffled,
    never whole texts: repeats are told apart once they are flat.
    """

    def run(batches):
        for pdf in batches:
            out: list = []
            for record, text in zip(pdf["r"], pdf["j"]):
                value = opened(read_json(text))
                if isinstance(value, dict):
                    for node in tree:
                        _visit(int(record), value, node, str(int(record)), out)
            yield pd.DataFrame(out, columns=["tag", "record", "pk", "parent", "pos", "at_key", "payload"])

    rows = df.select(F.col(record_col).cast("long").alias("r"), F.col(json_col).alias("j")).where("r IS NOT NULL AND j IS NOT NULL")
    return rows.mapInPandas(run, TAGGED).groupBy("record", "pk").agg(F.min(F.struct("tag", "parent", "pos", "at_key", "payload")).alias("e")).select("e.tag", "record", "pk", "e.parent", "e.pos", "e.at_key", "e.payload")


def apply_schema(rows: DataFrame, tag: str, schema: str) -> DataFrame:
    """The flat table of one tag: keys, position and the payload's fields by the schema."""
    return rows.where(F.col("tag") == tag).select("record", "pk", "parent", "pos", "at_key", F.from_json("payload", schema).alias("p")).select("record", "pk", "parent", "pos", "at_key", "p.*")


def write_tables(rows: DataFrame, path: str) -> None:
    """One folder per tag, so that each table can be read alone."""
    rows.write.mode("overwrite").partitionBy("tag").parquet(path)


def flat_tables(rows: DataFrame, schemas: dict[str, str], path: str) -> dict[str, DataFrame]:
    """The flat tables of all tags: written by tag to ``path`` in one visit, each read back alone with its schema. A tag without rows gives an empty table."""
    write_tables(rows, path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return {tag: apply_schema(back, tag, schema) for tag, schema in schemas.items()}
