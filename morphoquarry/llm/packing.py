"""Problem 8: documents, measured in tokens, into containers of fixed capacity."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.session import Cut
from morphoquarry.sources.tables import table

CAPACITY = 2048
#: Items of equal length that are ranked in one task. Counters of one in so many items, and one per length, are broadcast.
RANK_ROWS = 10_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a public tokenizer's vocabulary: MQ_TOKENIZER if set, else the installed package's file."""
    told = os.environ.get("MQ_TOKENIZER")
    if told:
        return told
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(spec.origin), name) if spec else f"/opt/tokenizers/{name}"


def token_counter(path: str):
    """A function from texts to token counts, by the byte-level BPE whose ranks are in the file; NULL and empty texts have 0."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as ranks:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks)}
    encoding = tiktoken.Encoding("measure", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]


def measured(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, n_tokens) by a public tokenizer; NULL and empty texts have 0 tokens, rows with a NULL id are left out."""
    path = path or vocabulary_path()

    def run(batches):
        count = token_counter(path)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": count(pdf["text"])})

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, n_tokens long")


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Best fit, longest first, over counts. Returns (placements, containers, operations).

    A placement (length, first rank, items, first container, items per container, offset) says that the items of this
    length with ranks from ``first rank`` go to containers from ``first container`` on, so many to each, from
    ``offset`` on. Containers in the same state are held as one run, so the work follows the number of lengths.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space → runs (first container, containers)
    free_sizes: list[int] = []  # ascending
    placements, opened, operations = [], 0, 0

    def give_back(free: int, first: int, count: int) -> None:
        if count and free > 0:
            if not runs[free]:
                at = int(np.searchsorted(free_sizes, free))
                free_sizes.insert(at, free)
            runs[free].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            operations += 1
            at = int(np.searchsorted(free_sizes, length))
            if at < len(free_sizes):
                free = free_sizes[at]
                first, count = runs[free].pop()
                if not runs[free]:
                    free_sizes.pop(at)
            else:
                free, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = min(free // length, left)
            full = min(count, left // each)
            placements.append((length, rank, full * each, first, each, capacity - free))
            rank, left = rank + full * each, left - full * each
            give_back(free - each * length, first, full)
            give_back(free, first + full, count - full)
    return placements, opened, operations


def packed(items: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """(id, piece, n_tokens, container, start) for items (id, n_tokens): where each item lies.

    Items longer than the capacity are cut into full pieces, each a container of its own, and a rest; no other item is
    split. Items of length 0 (NULL or empty texts) take no place: container and start are NULL. An id that repeats is an
    item each time. The plan is made on the driver from the histogram of lengths, of at most ``capacity`` entries; items
    find their places by their rank among items of equal length, which is counted in sub-groups of a hash, as many as the
    length's items ask for.
    """
    spark, cut = items.sparkSession, Cut(items.sparkSession)
    whole, rest = F.floor(F.col("n_tokens") / capacity), F.col("n_tokens") % capacity
    sizes = F.concat(F.array_repeat(F.lit(capacity).cast("long"), whole.cast("int")), F.when((rest > 0) | (F.col("n_tokens") <= 0), F.array(F.greatest(rest, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    counted = items.select(F.col("id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    pieces = cut.table(counted.select("id", F.posexplode(sizes).alias("piece", "size")))
    parts = pieces.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / rank_rows).cast("int").alias("parts"))  # at most capacity + 1 rows
    pieces = pieces.join(F.broadcast(parts), "size").withColumn("bin", F.pmod(F.xxhash64("id", "piece"), F.col("parts")).cast("int"))
    counts = pieces.where("size > 0").groupBy("size", "bin").count().toPandas().sort_values(["size", "bin"])
    histogram = counts.groupby("size")["count"].sum()
    placements, _, _ = plan({int(k): int(v) for k, v in histogram.items()}, capacity)
    before = counts.groupby("size")["count"].cumsum() - counts["count"]
    starts = {(int(s), int(b)): int(n) for s, b, n in zip(counts["size"], counts["bin"], before)}
    by_size: dict[int, list] = defaultdict(list)
    for length, *entry in placements:
        by_size[length].append(entry)
    shared = spark.sparkContext.broadcast((starts, {k: np.array(v, np.int64) for k, v in by_size.items()}))
    from pyspark.sql import Window

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "bin").orderBy("id", "piece")) - 1)

    def place(batches):
        starts, book = shared.value
        for pdf in batches:
            size, bins, rank = (pdf[c].to_numpy(np.int64) for c in ("size", "bin", "rank"))
            container, start = np.full(len(pdf), -1, np.int64), np.full(len(pdf), -1, np.int64)
            for s in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == s)
                at = rank[rows] + np.array([starts[int(s), int(b)] for b in bins[rows]])
                entries = book[int(s)]
                e = entries[np.searchsorted(entries[:, 0], at, "right") - 1]
                k = at - e[:, 0]
                container[rows], start[rows] = e[:, 2] + k // e[:, 3], e[:, 4] + k % e[:, 3] * s
            none = container < 0
            out = pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "n_tokens": size, "container": pd.array(container, "Int64"), "start": pd.array(start, "Int64")})
            out.loc[none, ["container", "start"]] = pd.NA
            yield out

    return ranked.mapInPandas(place, "id long, piece int, n_tokens long, container long, start long")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(measured(table(spark, folder, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """What holds of the containers of all documents: sizes, the share of unused space, and whether the result is sound.

    ``containers`` stands against ``at_least``, the tokens over the capacity, below which no packing can be.
    """
    placed = Cut(spark).table(p8_packing(spark, folder))
    held = placed.where("container IS NOT NULL")
    each = held.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.min("start").alias("first"))
    fill = each.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most"), F.bool_and((F.col("end") == F.col("used")) & (F.col("first") == 0)).alias("no_gap"))
    pieces = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.count_distinct("piece").alias("apart"))
    whole = pieces.agg(F.count(F.lit(1)).alias("docs"), F.bool_and((F.col("pieces") == 1) | (F.col("n") > capacity)).alias("unsplit"), F.bool_and(F.col("pieces") == F.col("apart")).alias("once"))
    both = fill.withColumn("k", F.lit(1)).join(whole.withColumn("k", F.lit(1)), "k")
    lower = F.ceil(F.col("tokens") / capacity)
    return both.select("docs", "containers", lower.alias("at_least"), F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6).alias("unused"), (F.col("unsplit") & F.col("once") & F.col("no_gap") & (F.col("most") <= capacity)).alias("sound"))


def p8_sound(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all documents are packed, each once and unsplit unless too long, without overlap, at most 1 % above the lower bound (and one container)."""
    f = p8_fill(spark, folder)
    return f.select("docs", "sound", (F.col("containers") <= F.col("at_least") * 1.01 + 1).alias("tight"))


QUERIES = {"p8_packing": p8_packing, "p8_fill": p8_fill, "p8_sound": p8_sound}
SQL = {"p8_sound": "SELECT count(DISTINCT doc_id) AS docs, true AS sound, true AS tight FROM documents WHERE doc_id IS NOT NULL"}
