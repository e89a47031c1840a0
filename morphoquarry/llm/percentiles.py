"""Problem 6: percentiles per group by mergeable sketches, combinable over days."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.llm.relsketch import RelSketch, dumped, is_plain, other_side
from morphoquarry.operators.unify import CommonUnits
from morphoquarry.session import Cut
from morphoquarry.sources.tables import table

#: Section size of the compactors: 0.4 % of the distance to the protected end, at one standard deviation.
K = 32
#: Rows of a partition that are sketched at a time.
FLUSH_ROWS = 1_000_000
#: Fixed value of the tables: an intensity that stands for no measurement.
SATURATED = 65535.0
MEASURES = ["intensity_mean", "area_um2", "volume_um3"]
#: Most groups whose percentiles (under 1 kB each) are broadcast to count ranks.
BROADCAST_GROUPS = 10_000
LOW, HIGH = (0.001, 0.01, 0.05, 0.1, 0.25), (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def _flush(frames: list[pd.DataFrame], keys: list[str], measures: list[str], k: int) -> pd.DataFrame:
    pdf = pd.concat(frames, ignore_index=True)
    codes = np.zeros(len(pdf), np.int64)
    for c in keys:
        code = pd.factorize(pdf[c], use_na_sentinel=False)[0]
        codes = pd.factorize(codes * (int(code.max(initial=0)) + 1) + code)[0]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    firsts = pdf[keys].iloc[order[starts]].reset_index(drop=True)
    out = []
    for m in measures:
        values = pdf[m].to_numpy(float)[order]
        some, data = [], []
        for i, (a, b) in enumerate(zip(starts, ends)):
            part = values[a:b]
            part = part[~np.isnan(part)]
            if len(part):
                some.append(i)
                high = dumped(part, k, True)
                data.append([None if is_plain(high) else dumped(part, k, False), high])
        frame = firsts.iloc[some].reset_index(drop=True)
        frame["measure"] = m
        frame["low"], frame["high"] = [d[0] for d in data], [d[1] for d in data]
        out.append(frame)
    return pd.concat(out, ignore_index=True)


def sketches(df: DataFrame, keys: list[str], measures: list[str], k: int = K) -> DataFrame:
    """(keys…, measure, low, high): one pair of sketches per key and measure, with the lower and the upper tail protected.

    ``low`` is NULL while ``high`` still holds every value, so that few values are sent once and not once for each tail.
    Each partition sketches its own rows, then only sketches are shuffled. NULL keys form a key of their own; NULL and
    NaN values are left out; a key without values has no row.
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)

    def partial(batches):
        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= FLUSH_ROWS:
                yield _flush(held, keys, measures, k)
                held, rows = [], 0
        if rows:
            yield _flush(held, keys, measures, k)

    parts = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures]).mapInPandas(partial, f"{kinds}, measure string, low binary, high binary")
    return merged(parts, [*keys, "measure"])


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Combines the sketches of equal keys, be they from partitions, days or stored tables."""
    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        # rows come sorted by key, so a key's sketches follow each other and only one key's are held
        key, held, out = None, ([], []), []

        def close():
            if held[1]:
                high = RelSketch.combined(held[1]).dump()
                out.append((*key, None if is_plain(high) else RelSketch.combined([other_side(b) if a is None else a for a, b in zip(*held)]).dump(), high))
            held[0].clear(), held[1].clear()

        for pdf in batches:
            for *now, low, high in pdf[[*keys, "low", "high"]].itertuples(index=False, name=None):
                now = tuple(None if v is pd.NaT or v != v else v for v in now)
                if now != key:
                    close()
                    key = now
                held[0].append(low), held[1].append(high)
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=[*keys, "low", "high"])
                out = []
        close()
        yield pd.DataFrame(out, columns=[*keys, "low", "high"])

    together = parts.select(*keys, "low", "high").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return together.mapInPandas(run, f"{kinds}, low binary, high binary")


def quantiles(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, percentile, value, n, rank_error): the value's true rank is within rank_error·n of percentile·n, at three standard deviations."""
    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                for shares, data in ((LOW, other_side(row.high) if row.low is None else row.low), (HIGH, row.high)):
                    one = RelSketch.load(data)
                    for share, value in zip(shares, one.quantiles(list(shares))):
                        out.append((*[getattr(row, c) for c in keys], share, value, one.n, one.rank_error(share)))
            yield pd.DataFrame(out, columns=[*keys, "percentile", "value", "n", "rank_error"])

    return parts.mapInPandas(run, f"{kinds}, percentile double, value double, n long, rank_error double")


def _values(spark: SparkSession, folder: str, saturated: float | None = SATURATED) -> DataFrame:
    """(treatment, day, intensity_mean, area_um2, volume_um3) of distinct objects; intensities equal to ``saturated`` are no measurements."""
    units = CommonUnits(table(spark, folder, "rpdf"), table(spark, folder, "exmd"), carry=("treatment",))
    objects = units.objects(("intensity_mean", "quantified_at"), places=False)
    intensity = F.col("intensity_mean")
    known = (intensity >= 0) & ~F.isnan(intensity)
    if saturated is not None:
        known &= intensity != saturated
    return objects.select(
        "treatment",
        F.to_date("quantified_at").alias("day"),
        F.when(known, intensity).alias("intensity_mean"),
        F.when(F.col("spatial_axes") == "YX", F.col("area") / 1000).alias("area_um2"),
        F.when(F.col("spatial_axes") == "ZYX", F.col("area") / 1000).alias("volume_um3"),
    )


def daily_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """(treatment, day, measure, low, high) over distinct objects; areas in µm², volumes in µm³."""
    return sketches(_values(spark, folder), ["treatment", "day"], MEASURES)


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's sketches are stored as a table, read back and combined over the days."""
    stored = Cut(spark).table(daily_sketches(spark, folder))
    return quantiles(merged(stored, ["treatment", "measure"]), ["treatment", "measure"])


def p6_ranks_within_error(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the true ranks of all percentiles, counted over all values, lie within the error told (a third more for chance)."""
    found = p6_percentiles(spark, folder)
    targets = Cut(spark).table(found.groupBy("treatment", "measure").agg(F.sort_array(F.collect_list(F.struct("percentile", "value", "rank_error", "n"))).alias("t")))
    few = F.broadcast(targets) if targets.count() <= BROADCAST_GROUPS else targets
    values = _values(spark, folder).unpivot(["treatment"], MEASURES, "measure", "v").where("v IS NOT NULL")
    met = values.withColumnRenamed("treatment", "g").join(few, F.col("g").eqNullSafe(F.col("treatment")) & (values["measure"] == targets["measure"])).select("treatment", targets["measure"], "v", "t")
    count = len(LOW) + len(HIGH)
    below = [F.count(F.when(F.col("v") < F.col("t")[i]["value"], 1)).alias(f"b{i}") for i in range(count)] + [F.count(F.when(F.col("v") <= F.col("t")[i]["value"], 1)).alias(f"u{i}") for i in range(count)]
    ranks = met.groupBy("treatment", "measure").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("n"), *below)
    ok = F.lit(True)
    for i in range(count):
        e = F.col("t")[i]
        slack = e["rank_error"] * 4 / 3 * F.col("n") + 1
        ok &= (F.col(f"b{i}") <= e["percentile"] * F.col("n") + slack) & (F.col(f"u{i}") >= e["percentile"] * F.col("n") - slack)
    return ranks.select("treatment", "measure", "n", ok.alias("within"))


def p6_intensity_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return p6_ranks_within_error(spark, folder).where("measure = 'intensity_mean'").select("treatment", "n", "within")


QUERIES = {"p6_percentiles": p6_percentiles, "p6_ranks_within_error": p6_ranks_within_error, "p6_intensity_ranks": p6_intensity_ranks}
SQL = {
    "p6_intensity_ranks": f"""SELECT treatment, count(*) AS n, true AS "within" FROM (SELECT DISTINCT obj_id, ex_i, intensity_mean FROM rpdf) LEFT JOIN (SELECT DISTINCT ex_i, treatment FROM exmd) USING (ex_i)
WHERE intensity_mean >= 0 AND NOT isnan(intensity_mean) AND intensity_mean <> {SATURATED} GROUP BY treatment"""
}
