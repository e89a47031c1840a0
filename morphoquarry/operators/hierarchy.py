"""Parent–child links of unknown depth: roots, depths, paths, descendants and loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphoquarry.session import Cut

#: Nodes of a component that one task may traverse alone (about 100 bytes a node, and its paths); larger ones are followed by joins.
TASK_NODES = 50_000
#: Nodes that a task traverses in all, over its components.
BIN_NODES = 100_000

FOUND = "id long, state string, root_id long, depth long, path string, names string, n_descendants long"


def components(links: DataFrame, cut: Cut) -> DataFrame:
    """(id, parent, comp) of links (id, parent; parent NULL at roots): comp is the root, or the smallest id of the loop.

    Pointers double until all ends are known: the set of pointers can no longer shrink once each is a root or on a loop,
    which takes a logarithm of the depth in rounds. Loops then agree on their smallest id in the same way.
    """
    ptr = cut.table(links.select("id", F.coalesce("parent", "id").alias("to")))
    ends = -1
    while (now := ptr.select("to").distinct().count()) != ends:
        ends = now
        step = ptr.join(ptr.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"))
        following = cut.table(step)
        cut.drop(ptr)
        ptr = following
    on_loop = cut.table(links.where("parent IS NOT NULL").join(ptr.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("low")))
    total = None
    while total != (now := on_loop.agg(F.sum(F.col("low").cast("decimal(38,0)"))).first()[0]):
        total = now
        other = on_loop.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("low2"))
        following = cut.table(on_loop.join(other, "to").select("id", F.col("next").alias("to"), F.least("low", "low2").alias("low")))
        cut.drop(on_loop)
        on_loop = following
    ends_named = ptr.join(on_loop.select(F.col("id").alias("to"), "low"), "to", "left").select("id", F.coalesce("low", "to").alias("comp"), F.col("low").isNotNull().alias("looped"))
    return cut.table(links.join(ends_named, "id"))


def _traverse(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depth-first over whole components, without recursion. White nodes are unseen, grey ones open, black ones done; a grey parent closes a loop."""
    ids, names = pdf["id"].to_numpy(), pdf["name"].tolist()
    place = {int(v): i for i, v in enumerate(ids)}
    parent = [place[p] if linked else -1 for p, linked in zip(pdf["parent"].tolist(), pdf["linked"])]
    n = len(ids)
    colour, state = bytearray(n), ["tree"] * n
    for start in range(n):  # up the parents: each node has one, so the walk up is the traversal that finds back edges
        walk, at = [], start
        while at >= 0 and colour[at] == 0:
            colour[at] = 1
            walk.append(at)
            at = parent[at]
        below = "tree" if at < 0 or state[at] == "tree" and colour[at] == 2 else "below_cycle"
        if at >= 0 and colour[at] == 1:
            loop = walk[walk.index(at) :]
            for i in loop:
                state[i] = "cycle"
            walk, below = walk[: len(walk) - len(loop)], "below_cycle"
            for i in loop:
                colour[i] = 2
        for i in walk:
            state[i] = below
            colour[i] = 2
    children: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    root, depth, path, named, count = [-1] * n, [-1] * n, [""] * n, [""] * n, [-1] * n
    for top in range(n):
        if parent[top] >= 0:
            continue
        stack, post = [top], []
        root[top], depth[top], path[top], named[top] = ids[top], 1, f"/{ids[top]}/", f"/{names[top]}/"
        while stack:
            i = stack.pop()
            post.append(i)
            count[i] = 0
            for c in children[i]:
                root[c], depth[c], path[c], named[c] = ids[top], depth[i] + 1, f"{path[i]}{ids[c]}/", f"{named[i]}{names[c]}/"
                stack.append(c)
        for i in reversed(post):
            if parent[i] >= 0:
                count[parent[i]] += count[i] + 1
    return pd.DataFrame({"id": ids, "state": state, "root_id": np.array(root, np.int64), "depth": np.array(depth, np.int64), "path": path, "names": named, "n_descendants": np.array(count, np.int64)})


def _followed(nodes: DataFrame, cut: Cut) -> DataFrame:
    """The same result by joins, for components too large for a task: its work follows the length of all paths, which is the result's size."""
    loops = nodes.where("looped").select("id", F.col("parent").alias("to"))
    # after as many doublings as the first search took, the pointers' ends are the loop itself
    ptr, ends = cut.table(loops), -1
    while (now := ptr.select("to").distinct().count()) != ends:
        ends = now
        following = cut.table(ptr.join(ptr.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
        cut.drop(ptr)
        ptr = following
    on_loop = ptr.select(F.col("to").alias("id")).distinct().withColumn("on", F.lit(True))
    nothing = [F.lit(-1).cast("long").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.lit("").alias("path"), F.lit("").alias("names"), F.lit(-1).cast("long").alias("n_descendants")]
    looped = loops.join(on_loop, "id", "left").select("id", F.when(F.col("on"), "cycle").otherwise("below_cycle").alias("state"), *nothing)
    steps = cut.table(nodes.where("NOT looped").select("id", F.col("parent").alias("to"), F.array("id").alias("ids"), F.array("name").alias("name_list")))
    while steps.where("to IS NOT NULL").limit(1).count():
        above = steps.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("ids").alias("ids2"), F.col("name_list").alias("names2"))
        joined = steps.join(above, "to", "left").select("id", F.col("next").alias("to"), F.concat(F.coalesce("ids2", F.array().cast("array<bigint>")), "ids").alias("ids"), F.concat(F.coalesce("names2", F.array().cast("array<string>")), "name_list").alias("name_list"))
        following = cut.table(joined)
        cut.drop(steps)
        steps = following
    below = steps.select(F.explode("ids").alias("id")).groupBy("id").agg((F.count("*") - 1).alias("n_descendants"))
    path = F.concat(F.lit("/"), F.array_join("ids", "/"), F.lit("/"))
    tree = steps.join(below, "id").select("id", F.lit("tree").alias("state"), F.col("ids")[0].alias("root_id"), F.size("ids").cast("long").alias("depth"), path.alias("path"), F.concat(F.lit("/"), F.array_join("name_list", "/"), F.lit("/")).alias("names"), "n_descendants")
    return tree.unionByName(looped)


def hierarchy(df: DataFrame, id_col: str, parent_col: str, name_col: str | None = None, task_nodes: int = TASK_NODES) -> DataFrame:
    """One row per id: state, root_id, depth (root 1), path of ids, path of names, and the number of its descendants.

    A root has a NULL parent or one that is no id. Nodes whose parents lead back to themselves are in state ``cycle``,
    nodes below such a loop in ``below_cycle``; both have −1 and '' elsewhere. Rows with a NULL id are no nodes; an id
    that repeats counts once, with its smallest parent (NULL last) and name; a NULL name is empty in the path.

    Components are found by pointer doubling. Those of at most ``task_nodes`` nodes are co-located and traversed
    depth-first, many to a task; larger ones, which would load one task, are followed by joins with the same result.
    """
    cut = Cut(df.sparkSession)
    name = F.coalesce(F.col(name_col).cast("string"), F.lit("")) if name_col else F.lit("")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("up"), name.alias("name")).where("id IS NOT NULL")
    nodes = cut.table(rows.groupBy("id").agg(F.min("up").alias("up"), F.min("name").alias("name")))
    links = nodes.join(nodes.select(F.col("id").alias("up"), F.col("id").alias("parent")), "up", "left").select("id", "parent", "name")
    located = components(links, cut)
    sizes = located.groupBy("comp").agg(F.count("*").alias("size"))
    large = cut.table(sizes.where(F.col("size") > task_nodes).select("comp"))
    total, any_large = located.count(), large.count() > 0
    small = located.join(large, "comp", "left_anti") if any_large else located
    bins = max(1, -(-total // BIN_NODES))
    out = small.select("id", F.coalesce("parent", "id").alias("parent"), F.col("parent").isNotNull().alias("linked"), "name", F.pmod(F.xxhash64("comp"), F.lit(4 * bins)).alias("bin")).groupBy("bin").applyInPandas(_traverse, FOUND)
    return out.unionByName(_followed(located.join(large, "comp", "left_semi"), cut)) if any_large else out


def closure(found: DataFrame) -> DataFrame:
    """(ancestor, descendant, steps) of all nodes in trees, each node with itself at 0 steps; as many rows as the paths have ids."""
    ids = F.filter(F.split("path", "/"), lambda p: p != "")
    return found.where("state = 'tree'").select(F.col("id").alias("descendant"), "depth", F.posexplode(ids).alias("at", "a")).select(F.col("a").cast("long").alias("ancestor"), "descendant", (F.col("depth") - 1 - F.col("at")).alias("steps"))
