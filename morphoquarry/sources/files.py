"""Scans of folders of tables, arrays, GeoJSON and trees, and listings of files."""

from __future__ import annotations

import fnmatch
import io
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators.geometry import RING


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, suffix, stem, modified, size) of the files below a folder, empty ones included; contents aren't read.

    The driver lists names, as it does for any scan; a folder that isn't there gives no rows.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    if fs.exists(root):
        each = fs.listFiles(root, True)
        while each.hasNext():
            f = each.next()
            if fnmatch.fnmatchcase(f.getPath().getName(), glob):
                found.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    files = spark.createDataFrame(found, "path string, ms long, size long").select("path", F.timestamp_millis("ms").alias("modified"), "size")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.nullif(F.regexp_extract(name, r"(\.[^.]+)$", 1), F.lit("")).alias("suffix"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), "modified", "size")


def matching(files: DataFrame, contains: str | None = None, starts: str | None = None, ends: str | None = None, regex: str | None = None) -> DataFrame:
    n = F.col("name")
    for given, test in ((contains, lambda v: n.contains(v)), (starts, lambda v: n.startswith(v)), (ends, lambda v: n.endswith(v)), (regex, lambda v: n.rlike(v))):
        if given is not None:
            files = files.where(test(given))
    return files


def most_recent(files: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The newest file, per key if given; ties go to the last path."""
    newest = F.max_by("path", F.struct("modified", "path")).alias("path")
    return files.groupBy(*keys).agg(newest) if keys else files.agg(newest).where("path IS NOT NULL")


def progress(files: DataFrame, example: Column, required: list[str], done: str = "summary.csv", skip: str = "SKIP") -> DataFrame:
    """(example, n_files, status): complete, skip, ready (all required names are there) or missing; an inner list of names means any of them."""
    groups = files.withColumn("example", example).where(F.col("example") != "").groupBy("example").agg(F.count(F.lit(1)).alias("n_files"), F.collect_set("name").alias("names"))
    has = lambda name: F.array_contains("names", name)
    ready = F.lit(True)
    for r in required:
        ready &= F.coalesce(*[F.when(has(x), True) for x in (r if isinstance(r, list) else [r])], F.lit(False))
    return groups.select("example", "n_files", F.when(has(skip), "skip").when(has(done), "complete").when(ready, "ready").otherwise("missing").alias("status"))


def read_csv_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Each table as <folder>/<name>.csv, a file or a folder of parts, with a schema: nothing is inferred, empty files give no rows."""
    return {name: spark.read.option("header", True).option("escape", '"').schema(schema).csv(f"{folder}/{name}.csv") for name, schema in schemas.items()}


def read_features(spark: SparkSession, path: str, name_filter: str | None = None) -> DataFrame:
    """(feature, name, kind, part, ring, holes, properties) of the polygons of GeoJSON feature collections, one row per part.

    Files are read whole, one record each. Features without a polygon are left out, as are those whose name doesn't
    match the filter. Raises ValueError in the task for a file that is no feature collection.
    """
    texts = spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("file"))

    def run(batches):
        as_ring = lambda pts: [{"x": float(p[0]), "y": float(p[1])} for p in pts]
        for pdf in batches:
            out = []
            for file, text in zip(pdf["file"], pdf["value"]):
                whole = json.loads(text)
                features = whole if isinstance(whole, list) else whole.get("features")
                if features is None:
                    raise ValueError(f"no feature collection: {file}")
                for k, f in enumerate(features):
                    shape, told = f.get("geometry") or {}, f.get("properties") or {}
                    name = (told.get("classification") or {}).get("name") or told.get("name")
                    if shape.get("type") not in ("Polygon", "MultiPolygon") or (name_filter and not re.search(name_filter, name or "")):
                        continue
                    for part, rings in enumerate([shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"]):
                        out.append((str(f.get("id", k)), name, shape["type"], part, as_ring(rings[0]), [as_ring(r) for r in rings[1:]] or None, json.dumps(told)))
            yield pd.DataFrame(out, columns=["feature", "name", "kind", "part", "ring", "holes", "properties"])

    return texts.mapInPandas(run, f"feature string, name string, kind string, part int, ring {RING}, holes array<{RING}>, properties string")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent, name, acronym, st_level) of a nested JSON tree ('msg', 'root' or the node itself; 'children' lists)."""
    texts = spark.read.option("wholetext", True).text(path)

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["value"]:
                top = json.loads(text)
                top = top.get("msg", top.get("root", top)) if isinstance(top, dict) else top
                todo = [(n, None, 1) for n in (top if isinstance(top, list) else [top])]
                while todo:
                    node, parent, level = todo.pop()
                    out.append((node.get("id"), parent, node.get("name"), node.get("acronym"), level))
                    todo.extend((c, node.get("id"), level + 1) for c in node.get("children") or [])
            yield pd.DataFrame(out, columns=["id", "parent", "name", "acronym", "st_level"]).astype({"id": "Int64", "parent": "Int64"})

    return texts.mapInPandas(run, "id long, parent long, name string, acronym string, st_level int")


def tree_from_paths(df: DataFrame, id_col: str = "id", path_col: str = "structure_id_path") -> DataFrame:
    """Adds parent and st_level from a path '/1/5/9/'; a path of one id is a root."""
    ids = F.filter(F.split(path_col, "/"), lambda p: p != "")
    return df.withColumns({"parent": F.when(F.size(ids) > 1, F.element_at(ids, -2).cast("long")), "st_level": F.size(ids)})


def read_records(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, record, error): JSON files as text, with what is wrong with those that can't be read; no file ends the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            out = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((file, json.dumps(json.loads(bytes(content).decode())), None))
                except (ValueError, UnicodeDecodeError) as e:
                    out.append((file, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "record", "error"])

    return files.mapInPandas(run, "path string, record string, error string")


_SLICE = re.compile(r"^\s*(-?\d+)?\s*:\s*(-?\d+)?\s*(?::\s*(-?\d+)?\s*)?$")


def slice_of(text: str | int | None) -> slice | int:
    """'a:b', 'a:b:s', a number or nothing, as in an array's index."""
    if text is None or isinstance(text, int):
        return slice(None) if text is None else text
    if found := _SLICE.match(text):
        return slice(*[int(v) if v is not None else None for v in found.groups()])
    return int(text)


def in_slice(column: str, text: str | int | None, length: int) -> Column:
    """Whether an axis position lies in a slice of an axis of this length."""
    s = slice_of(text)
    if isinstance(s, int):
        return F.col(column) == (s if s >= 0 else s + length)
    places = range(*s.indices(length))
    if not places:
        return F.lit(False)
    low, high = min(places[0], places[-1]), max(places[0], places[-1])
    return F.col(column).between(low, high) & ((F.col(column) - low) % abs(places.step) == 0)


def read_arrays(spark: SparkSession, path: str, axes: str, keep_zero: bool = False) -> DataFrame:
    """(path, one column per axis, value) of .npy arrays as a long table; 0, the background, is left out unless asked for."""
    names = list(axes.lower())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                array = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                if array.ndim != len(names):
                    raise ValueError(f"{file} has {array.ndim} axes, not {axes}")
                for at in range(array.shape[0]):  # a plane at a time
                    plane = array[at]
                    places = np.nonzero(plane) if not keep_zero else [x.ravel() for x in np.indices(plane.shape)]
                    out = {"path": file, names[0]: np.full(len(places[0]), at) if len(names) > 1 else np.zeros(0, int)}
                    if len(names) == 1:
                        break
                    yield pd.DataFrame(out | {n: p for n, p in zip(names[1:], places)} | {"value": plane[tuple(places)].astype(float)})
                if len(names) == 1:
                    places = np.arange(len(array)) if keep_zero else np.flatnonzero(array)
                    yield pd.DataFrame({"path": file, names[0]: places, "value": array[places].astype(float)})

    return files.mapInPandas(run, "path string, " + ", ".join(f"{n} long" for n in names) + ", value double")


_VARIABLE = re.compile(r"\$\{(\w+)\}")


def read_config(path: str, extra: dict[str, str] | None = None) -> dict:
    """A YAML or JSON file with ${NAME} and '!ENV NAME' replaced; unknown names raise KeyError."""
    values = dict(os.environ) | (extra or {})
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        tree = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs PyYAML; JSON works without") from e

        class Loader(yaml.SafeLoader):
            pass

        Loader.add_constructor("!ENV", lambda loader, node: "${" + loader.construct_scalar(node).strip() + "}")
        Loader.add_constructor("tag:yaml.org,2002:python/tuple", lambda loader, node: tuple(loader.construct_sequence(node)))
        tree = yaml.load(text, Loader)  # noqa: S506

    def filled(v):
        if isinstance(v, dict):
            return {k: filled(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return type(v)(filled(x) for x in v)
        return _VARIABLE.sub(lambda m: values[m[1]], v) if isinstance(v, str) else v

    return filled(tree)
