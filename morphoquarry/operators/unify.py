"""Quantities in different units to common ones, by a fuzzy dictionary of unit spellings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphoquarry.functions.units import ALIASES, close_enough, parse_notes, parse_scaling, split_unit

#: A dictionary of at most so many spellings is broadcast (under 10 MB); a larger one is joined by shuffle.
BROADCAST_SPELLINGS = 100_000


@F.pandas_udf(T.StructType([T.StructField("base", T.StringType()), T.StructField("power", T.IntegerType())]))
def _split(spelling: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_unit(s) for s in spelling], columns=["base", "power"])


@F.pandas_udf(T.DoubleType())
def _distance(base: pd.Series, alias: pd.Series) -> pd.Series:
    return pd.Series([close_enough(a, b) for a, b in zip(base, alias)], dtype=float)


def _grams(c: Column) -> Column:
    """Distinct letter pairs of ^text$."""
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2))))


def unit_dictionary(spellings: DataFrame) -> DataFrame:
    """(spelling, unit, power, pm) for a DataFrame of distinct spellings in the column ``spelling``; unknown ones are left out.

    An inverted index of letter pairs proposes aliases that share at least a third of the spelling's pairs; a weighted
    edit distance accepts or rejects them. The nearest alias counts, ties go to the alias first in the alphabet.
    ``pm`` is the unit's length in picometres, 0 for pixels and voxels.
    """
    spark = spellings.sparkSession
    known = spark.createDataFrame(ALIASES, "alias string, unit string, pm double")
    index = known.select("alias", "unit", "pm", F.explode(_grams(F.col("alias"))).alias("gram"))
    parts = spellings.where(F.col("spelling").isNotNull()).select("spelling", _split("spelling").alias("s")).select("spelling", "s.base", "s.power").where(F.length("base") > 0)
    probes = parts.select("spelling", "base", "power", F.size(_grams(F.col("base"))).alias("n"), F.explode(_grams(F.col("base"))).alias("gram"))
    shared = probes.join(F.broadcast(index), "gram").groupBy("spelling", "base", "power", "n", "alias", "unit", "pm").agg(F.count("*").alias("hits"))
    near = shared.where(F.col("hits") * 3 >= F.col("n")).withColumn("d", _distance("base", "alias")).where(F.col("d").isNotNull() & ~F.isnan("d"))
    return near.groupBy("spelling").agg(F.min_by(F.struct("unit", "power", "pm"), F.struct("d", "alias")).alias("u")).select("spelling", "u.unit", "u.power", "u.pm")


def bounded(dictionary: DataFrame) -> tuple[DataFrame, bool]:
    """The dictionary as a local table if its size allows to broadcast it."""
    head = dictionary.limit(BROADCAST_SPELLINGS + 1).toPandas()
    if len(head) > BROADCAST_SPELLINGS:
        return dictionary, False
    rows = [(s, u, int(p), float(pm)) for s, u, p, pm in head.itertuples(index=False)]
    return dictionary.sparkSession.createDataFrame(rows, "spelling string, unit string, power int, pm double"), True


def look_up(df: DataFrame, column: str, dictionary: tuple[DataFrame, bool], out: str) -> DataFrame:
    """Adds ``out``: the picometres of the unit spelled in ``column``, 0 for pixels, NULL if unknown."""
    names, small = dictionary
    names = names.select(F.col("spelling").alias(f"_{out}_key"), F.col("pm").alias(out))
    return df.join(F.broadcast(names) if small else names, F.col(column) == F.col(f"_{out}_key"), "left").drop(f"_{out}_key")


def read_examples(exmd: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per example: the numbers and unit texts of its scaling, the units its notes tell, and columns to carry as they are."""
    fields = [f"{a}_{p}" for a in "xyz" for p in ("num", "unit", "inverse")]
    schema = "ex_i string, spatial_axes string, px_unit string, " + ", ".join(f"{a}_num double, {a}_unit string, {a}_inverse boolean" for a in "xyz") + ", area_note string, place_note string" + "".join(f", {c} {exmd.schema[c].dataType.simpleString()}" for c in carry)

    def read(batches):
        for pdf in batches:
            out = {"ex_i": pdf["ex_i"], "spatial_axes": pdf["spatial_axes"], "px_unit": pdf["px_sizes_unit"]}
            parsed = [parse_scaling(s) for s in pdf["scaling"]]
            for f in fields:
                axis, k = f[0].upper(), ("num", "unit", "inverse").index(f[2:])
                out[f] = [p[axis][k] if axis in p else None for p in parsed]
            notes = [parse_notes(n) for n in pdf["notes"]]
            out["area_note"], out["place_note"] = [n[0] for n in notes], [n[1] for n in notes]
            yield pd.DataFrame(out | {c: pdf[c] for c in carry})

    return exmd.select("ex_i", *carry, "spatial_axes", "px_sizes_unit", "notes", F.col("image_metadata.scaling").alias("scaling")).mapInPandas(read, schema)


class CommonUnits:
    """Examples and objects with their quantities in common units.

    ``examples``: ex_i, spatial_axes, x_pm, y_pm, z_pm (picometres per voxel or NULL), area_note_pm, place_note_pm.
    ``carry`` names columns of exmd that examples and objects keep.
    ``objects(carry)``: one row per object with area (thousandths of µm² or µm³, by the example's axes) and centroid
    (nm, in recorded order), both NULL where there is no case; ``places=False`` leaves centroids out.

    A scaling's own unit counts first, then px_sizes_unit, then metres; a unit that can't be read counts as none.
    Areas not above 0, NULL or NaN have no value; neither have centroids with NULL or NaN or in pixels. Objects whose
    example is missing or NULL keep NULL. Repeated rows (equal in the columns used) come out once.
    """

    def __init__(self, rpdf: DataFrame, exmd: DataFrame, cut=None, carry: tuple[str, ...] = ()):
        self.rpdf = rpdf
        read = read_examples(exmd, carry)
        if cut:
            read = cut.table(read)
        told = [read.select(F.explode(F.array("px_unit", "x_unit", "y_unit", "z_unit", "area_note", "place_note")).alias("spelling"))]
        told.append(rpdf.select("area_unit", "centroid_unit").distinct().select(F.explode(F.array("area_unit", "centroid_unit")).alias("spelling")))
        self.dictionary = bounded(unit_dictionary(told[0].unionAll(told[1]).where("spelling IS NOT NULL").distinct()))
        out = read
        for c in ("px_unit", "x_unit", "y_unit", "z_unit", "area_note", "place_note"):
            out = look_up(out, c, self.dictionary, f"{c}_pm")

        def voxel(a: str) -> Column:
            size = F.coalesce(F.nullif(F.col(f"{a}_unit_pm"), F.lit(0.0)), F.nullif(F.col("px_unit_pm"), F.lit(0.0)), F.lit(1e12))
            return F.when(F.col(f"{a}_inverse"), F.try_divide(size, F.col(f"{a}_num"))).otherwise(F.col(f"{a}_num") * size)

        self.examples = out.select("ex_i", *carry, "spatial_axes", *[voxel(a).alias(f"{a}_pm") for a in "xyz"], "area_note_pm", "place_note_pm")

    def objects(self, carry: tuple[str, ...] = (), places: bool = True) -> DataFrame:
        c = F.col("centroid")
        valid = F.size(c).between(2, 3) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
        rows = self.rpdf.select("obj_id", "ex_i", *carry, F.when((F.col("area") > 0) & ~F.isnan("area"), F.col("area")).alias("area"), F.when(valid, c).alias("centroid"), "area_unit", "centroid_unit")
        if not places:
            rows = rows.withColumn("centroid", F.lit(None).cast("array<double>")).withColumn("centroid_unit", F.lit(None).cast("string"))
        rows = look_up(look_up(rows, "area_unit", self.dictionary, "a_pm"), "centroid_unit", self.dictionary, "c_pm")
        rows = rows.withColumn("centroid", F.when(F.coalesce(F.col("c_pm"), F.lit(-1.0)) != 0, F.col("centroid"))).drop("area_unit", "centroid_unit")
        rows = rows.dropDuplicates()
        e = self.examples.withColumnRenamed("ex_i", "_ex")
        out = rows.join(e, F.col("ex_i") == F.col("_ex"), "left").drop("_ex")
        flat = F.col("spatial_axes") == "YX"
        deep = F.col("spatial_axes") == "ZYX"
        area_pm = F.coalesce("a_pm", "area_note_pm", F.lit(0.0))
        # picometres to the power of the axes, over the size of a thousandth of µm² (1e9 pm²) or µm³ (1e15 pm³)
        by_unit = F.when(flat, _scaled(F.col("area"), area_pm, 2)).when(deep, _scaled(F.col("area"), area_pm, 3))
        by_voxel = F.when(flat, F.col("area") * (F.col("x_pm") * F.col("y_pm")) / 1e9).when(deep, F.col("area") * (F.col("x_pm") * F.col("y_pm") * F.col("z_pm")) / 1e15)
        place_pm = F.nullif(F.coalesce("c_pm", "place_note_pm"), F.lit(0.0))
        out = out.withColumn("area", F.when(area_pm == 0, by_voxel).otherwise(by_unit))
        return out.withColumn("centroid", F.when(place_pm.isNotNull(), F.transform("centroid", lambda v: F.when(place_pm >= 1000, v * (place_pm / 1000)).otherwise(v / (1000 / place_pm)))))


def _scaled(area: Column, pm: Column, power: int) -> Column:
    """area · pm^power in thousandths of µm^power, with one rounding: the factor or its inverse is a whole power of ten."""
    up = F.pow(pm / 1e6, F.lit(power)) * 1000
    down = F.pow(1e6 / pm, F.lit(power)) / 1000
    return F.when(pm == 0, None).when(pm >= 1e6, area * F.rint(up)).otherwise(area / F.rint(down))
