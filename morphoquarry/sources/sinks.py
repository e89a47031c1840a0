"""Writers: CSV with nested values as JSON text, resumable parts, GeoJSON, provenance."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)


def nested_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    nested_as_text(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_all(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per container of the run."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}.csv")


def write_parts(df: DataFrame, path: str, key: str = "ex_i") -> None:
    """Parts by key; a later write replaces the parts of its own keys only, so an interrupted run goes on where it stopped."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def left_to_do(df: DataFrame, done: DataFrame, key: str = "ex_i") -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def features(df: DataFrame, ring: str, holes: str | None, properties: list[str]) -> DataFrame:
    """(value): one GeoJSON feature as text per polygon; rings are closed."""
    pair = lambda p: F.array(p["x"], p["y"])
    closed = lambda r: F.transform(F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))), pair)
    rings = F.array(closed(F.col(ring)))
    if holes:
        rings = F.concat(rings, F.coalesce(F.transform(holes, closed), F.array().cast("array<array<array<double>>>")))
    shape = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    told = F.struct(*[F.col(c) for c in properties]) if properties else F.struct(F.lit(None).cast("string").alias("name"))
    return df.where(F.size(ring) > 2).select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), told.alias("properties"))).alias("value"))


def write_features(df: DataFrame, path: str, ring: str = "ring", holes: str | None = "holes", properties: list[str] = []) -> None:  # noqa: B006
    """Each part file is one feature collection: the features of a partition are joined line by line."""

    def collect(batches):
        import pandas as pd

        lines = [v for pdf in batches for v in pdf["value"]]
        if lines:
            yield pd.DataFrame({"value": ['{"type":"FeatureCollection","features":[' + ",".join(lines) + "]}"]})

    features(df, ring, holes, properties).mapInPandas(collect, "value string").write.mode("overwrite").option("lineSep", "\n").text(path)


def merged_metadata(old: dict, new: dict) -> dict:
    """Nested mappings merged: a new leaf wins, mappings recurse, None leaves what was there."""
    out = dict(old)
    for k, v in new.items():
        out[k] = merged_metadata(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else out.get(k) if v is None else v
    return out


def write_provenance(path: str, config: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f, indent=1, sort_keys=True, default=str)
