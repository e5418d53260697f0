"""Groups of related records, and splits that keep every group in one part.

Grouping is a distributed union-find. Every partition of links builds its own forest and sends on one link per node that is not a root; forests of
neighbouring partitions are merged, ``fan_in`` at a time, as long as a merged forest stays within ``task_links``. What is still apart then (only for graphs
whose forests outgrow a task) is joined by alternating large-star and small-star steps, which are plain joins and aggregations. Before
that, every level contracts the graph to the roots that met in some node. Nothing is gathered whole.

Parts are assigned greedily, largest group first, to the part furthest below its target. Groups of equal size are interchangeable, so
the decision runs on the histogram of sizes (at most sqrt(2 * records) rows) in closed form, and groups draw their part by a hashed order within their size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.skew import join_heavy
from platewise.session import materialize

PARTS = {"train": 0.65, "val": 0.15, "test": 0.20}


class Forest:
    """Union-find over strings; the root of a tree is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, node: str) -> str:
        root = node
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(node, node)) != root:
            self.parent[node] = root
            node = up
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low


#: Nodes a task's forest may hold; a fuller one is sent on and a new one begun, which only leaves more to merge.
HELD_NODES = 600_000


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def links(forest: Forest) -> Iterator[pd.DataFrame]:
        nodes = list(forest.parent)
        for i in range(0, len(nodes), 50_000):
            some = nodes[i : i + 50_000]
            yield pd.DataFrame({"a": some, "b": [forest.find(x) for x in some]})

    forest = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            forest.union(a, b)
        if len(forest.parent) > HELD_NODES:
            yield from links(forest)
            forest = Forest()
    yield from links(forest)


def components(links: DataFrame, fan_in: int = 8, task_links: int = 500_000) -> DataFrame:
    """(``node``, ``component``) for every node of ``links`` (string columns ``a``, ``b``); the component's name is its smallest node.

    Forests are merged within tasks only while they average at most ``task_links`` links a task; beyond that star steps take over.

    A link of a node to itself makes it a component of its own. Links with a null end are left out; repeated links change nothing."""
    if task_links > HELD_NODES:
        raise ValueError(f"task_links may be {HELD_NODES} at most")
    links = links.filter("a is not null and b is not null")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    forest = materialize(links.filter("a <> b").mapInPandas(_local_forest, "a string, b string"), "forest")
    stars = _merge(forest, fan_in, task_links)
    return nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _merge(forest: DataFrame, fan_in: int, task_links: int) -> DataFrame:
    """Local forests (a, b: a's root in some task) merged into stars (a, b: the smallest node of a's component); one row per node that is not its component's root.

    A forest that outgrows the tasks is contracted: nodes take their smallest root, and only the roots that met in some node go on, as a smaller graph, to the next level."""
    count, width = forest.count(), forest.rdd.getNumPartitions()
    while count <= task_links * max(1, width // fan_in):
        width = max(1, width // fan_in)
        # each task merges its share of the forests of the level below
        forest = materialize(forest.coalesce(width).mapInPandas(_local_forest, "a string, b string"), "forest")
        if width == 1:
            return forest
        count = forest.count()
    per = materialize(forest.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("n")), "forest-roots")
    met = forest.join(per.filter("m <> n").select("a", "m"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    chained = per.join(forest.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", F.col("m").alias("b"))
    rest = materialize(met.union(chained).distinct(), "forest-rest")
    left = rest.count()
    if left == 0:
        return per.select("a", F.col("m").alias("b"))
    top = _stars(rest) if left > 0.7 * count else _merge(materialize(rest.mapInPandas(_local_forest, "a string, b string"), "forest"), fan_in, task_links)
    # a root may stand for a third of all nodes
    labelled = join_heavy(per.select("a", "m"), top.select(F.col("a").alias("m"), F.col("b").alias("up")), "m").select("a", F.coalesce("up", "m").alias("b"))
    return labelled.union(top.select("a", "b")).groupBy("a").agg(F.min("b").alias("b"))


def _stars(forest: DataFrame) -> DataFrame:
    """Stars (node, root) by large-star and small-star steps until nothing changes, which takes O(log^2) rounds.

    A node that very many others hang on is a heavy join key; :func:`join_heavy` keeps its links where they are."""
    edges, mark = forest, None
    while True:
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_heavy(both.filter("b > a"), lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = join_heavy(down, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).filter("a <> b").distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges
        mark = now


# ---------------------------------------------------------------------------------------------------------------------


def allot(sizes: Mapping[int, int], shares: Mapping[str, float]) -> dict[int, dict[str, int]]:
    """How many groups of each size go to each part: largest first, each to the part furthest below its target (ties: order of ``shares``).

    For m groups of one size the greedy picks are the m largest terms of the descending series deficit - j * size of all parts, so each
    series is cut at a common level found by bisection instead of one step a group."""
    total = sum(s * n for s, n in sizes.items())
    deficit = {p: share * total for p, share in shares.items()}
    names, result = list(shares), {}
    for size in sorted(sizes, reverse=True):
        count = sizes[size]
        given = dict.fromkeys(names, 0)
        if count > 64:
            low, high = min(deficit.values()) - size * count, max(deficit.values())
            for _ in range(200):
                level = (low + high) / 2
                if sum(max(0, int(np.floor((deficit[p] - level) / size)) + 1) if deficit[p] >= level else 0 for p in names) > count:
                    low = level
                else:
                    high = level
            for p in names:
                given[p] = max(0, int(np.floor((deficit[p] - high) / size)) + 1) if deficit[p] >= high else 0
                deficit[p] -= size * given[p]
        heap = [(-deficit[p], i, p) for i, p in enumerate(names)]
        heapq.heapify(heap)
        for _ in range(count - sum(given.values())):
            d, i, p = heap[0]
            given[p] += 1
            heapq.heapreplace(heap, (d + size, i, p))
        for d, _, p in heap:
            deficit[p] = -d
        result[size] = given
    return result


def assign_parts(groups: DataFrame, shares: Mapping[str, float] = PARTS, seed: str = "0", bucket_rows: int = 100_000) -> DataFrame:
    """(``component``, ``size``, ``part``) for ``groups`` (``component``, ``size``): greedy largest-first towards ``shares``.

    Equal sizes take their parts in the order of md5(seed | component). That order is found without one big sort: hash-prefix buckets of about ``bucket_rows``
    groups are counted, and only within a bucket are groups numbered. The driver sees the histogram of sizes (at most sqrt(2 * records) rows), never groups or buckets."""
    number = groups.count()
    width = max(1, number // bucket_rows)
    hashed = groups.withColumn("h", F.md5(F.concat(F.lit(seed), F.lit("|"), F.col("component"))))
    hashed = hashed.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * width / F.lit(1 << 32)).cast("int"))
    counts = materialize(hashed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")), "part-counts")
    sizes = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    rows = []
    for size, given in allot(sizes, shares).items():
        upto = 0
        for part, n in given.items():
            rows.append((size, part, upto, upto + n))
            upto += n
    # as many cuts as there are sizes and parts; the starts of the buckets stay in Spark
    cuts = F.broadcast(groups.sparkSession.createDataFrame(rows, "size long, part string, lo long, hi long"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).drop("n")
    placed = hashed.join(starts, ["size", "bucket"]).withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("size", "bucket").orderBy("h", "component")) - 1)
    return placed.join(cuts, "size").filter("place >= lo and place < hi").select("component", "size", "part")


def group_split(records: DataFrame, record: str, units: Mapping[str, Column], shares: Mapping[str, float] = PARTS, seed: str = "0") -> DataFrame:
    """(``record``, ``component``, ``part``): every record gets a part, and records that share a value of any of ``units`` share the part.

    ``records`` has one row per record; a null unit links to nothing; without units every record stands alone. A record name must not be null. One component may hold all records:
    its rows take their part where they are."""
    rec = F.concat(F.lit("r|"), F.col(record))
    ends = [F.when(u.isNotNull(), F.concat(F.lit(f"u{i}|"), u)) for i, u in enumerate(units.values())]
    links = records.select(rec.alias("a"), F.explode(F.array(rec, *ends)).alias("b")).filter("b is not null")
    found = materialize(components(links), "components").filter(F.col("node").startswith("r|"))
    sizes = materialize(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component-sizes")
    parts = assign_parts(sizes, shares, seed).select("component", "part")
    return join_heavy(found, parts, "component", sizes.withColumnRenamed("size", "n_rows")).select(F.expr("substring(node, 3)").alias(record), "component", "part")


def crossed_split(records: DataFrame, record: str, units: Mapping[str, Column], shares: Mapping[str, float] = PARTS, seed: str = "0") -> DataFrame:
    """(``record``, one part column per unit, ``part``): every kind of unit is split on its own, and a record keeps a part only where all its units have it.

    Units are split at the n-th roots of ``shares`` (scaled to 1), so that the records kept, those for which n independent draws agree, come out at ``shares``. A way out where units of several kinds chain nearly all records into one component, which :func:`group_split` can only give to one part. The price is stated, not hidden: a
    record whose units fell apart has a null ``part``. A record without any unit of a kind is drawn alone in it. No unit has records in two parts."""
    out = records.select(record)
    roots = {p: s ** (1 / len(units)) for p, s in shares.items()}
    each = {p: r / sum(roots.values()) for p, r in roots.items()}
    for name, unit in units.items():
        one = group_split(records, record, {name: unit}, each, f"{seed}|{name}").select(record, F.col("part").alias(f"{name}_part"))
        out = out.join(one, record)
    parts = [F.col(f"{n}_part") for n in units]
    same = F.lit(True)
    for p in parts[1:]:
        same = same & (p == parts[0])
    return out.withColumn("part", F.when(same, parts[0]))


def torn_units(delivered: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., ``unit``): units of ``delivered`` (scope..., ``rec``, ``unit``, ``part``) with rows in more than one part within a scope.

    Records are linked to their unit within the scope by :func:`components`; a component with two parts is torn. Null parts do not count, a null unit or
    record links to nothing, repeated rows change nothing; an empty table gives no rows."""
    rows = delivered.filter("part is not null and unit is not null and rec is not null").select(*scope, "rec", "unit", "part")
    # the unit's node sorts before its records' nodes, so it names the component
    head = F.concat_ws("~", *[F.coalesce(F.col(s).cast("string"), F.lit("\\N")) for s in scope])
    named = rows.withColumn("a", F.concat(F.lit("1|"), head, F.lit("|"), F.col("rec"))).withColumn("b", F.concat(F.lit("0|"), head, F.lit("|"), F.col("unit")))
    found = components(named.select("a", "b").distinct()).filter(F.col("node").startswith("1|"))
    # a record's node is met once per unit and part it is listed with, so no key of this join is heavy
    parts = named.join(found, named["a"] == found["node"]).groupBy(*scope, "component").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("unit").alias("unit"))
    return parts.filter("p <> q").select(*scope, "unit")
