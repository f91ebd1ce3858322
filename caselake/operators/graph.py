"""Edges of several tables as one relation, bounded traversal, paths, identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.staging import scratch, stage

MAX_HOPS = 8  # fixed value


def union(*edges: DataFrame) -> DataFrame:
    """Bag union to (src, dst, type); columns that a table lacks are null."""
    whole = [reduce(lambda d, c: d if c in d.columns else d.withColumn(c, F.lit(None).cast("string")), ("src", "dst", "type"), e) for e in edges]
    return reduce(DataFrame.unionByName, [e.select("src", "dst", "type") for e in whole])


def edge_key(*cols: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def of_types(edges: DataFrame, types: str | None) -> DataFrame:
    """Edges of a comma list of types, whatever its case; all without a list."""
    wanted = [x.strip().upper() for x in (types or "").split(",") if x.strip()]
    return edges.where(F.upper("type").isin(wanted)) if wanted else edges


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def bounded(value: int, least: int, most: int, what: str) -> int:
    if not isinstance(value, int) or not least <= value <= most:
        raise ValueError(f"{what} must be from {least} to {most}")
    return value


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select("src", "dst", "type", F.lit(False).alias("reverse"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", F.lit(True).alias("reverse"))
    if direction not in ("in", "out", "both"):
        raise ValueError("direction must be in, out or both")
    return out if direction == "out" else back if direction == "in" else out.union(back)


def _expanded(start: DataFrame, steps: DataFrame, hops: int) -> DataFrame:
    """start(node, ...) and what its columns become along steps(src, dst): each node once, at its least depth and there
    with the least of the other columns. A hop joins only the nodes that the one before it found; frontiers are staged,
    so no plan holds more than one hop, and the walk ends when nothing new is found."""
    others = [c for c in start.columns if c != "node"]
    with scratch(start.sparkSession):
        seen = stage(start.withColumn("depth", F.lit(0)), "seen")
        frontier, found = seen, [seen]
        for hop in range(1, hops + 1):
            reached = steps.join(frontier.select(F.col("node").alias("src"), *others), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(*others)).alias("o") if others else F.lit(0).alias("o"))
            reached = reached.select("node", *[F.col(f"o.{c}").alias(c) for c in others])
            known = reduce(DataFrame.union, [d.select("node") for d in found])
            frontier = stage(reached.join(known, "node", "left_anti").withColumn("depth", F.lit(hop)), "frontier")
            if frontier.isEmpty():
                break
            found.append(frontier)
        return stage(reduce(DataFrame.unionByName, found), "reached", keep=True)


def neighbors(edges: DataFrame, start: str, hops: int, direction: str = "both", types: str | None = None, limit: int | None = None) -> DataFrame:
    """node, depth of all nodes at most `hops` edges from start. With a limit, that many by depth and node, and
    `truncated` where there were more."""
    bounded(hops, 0, MAX_HOPS, "hops")
    steps = _steps(of_types(edges, types), direction).select("src", "dst").distinct()
    found = _expanded(edges.sparkSession.createDataFrame([(start,)], "node string"), steps, hops)
    if limit is None:
        return found
    first = found.orderBy("depth", "node").limit(limit + 1).withColumn("__n", F.row_number().over(Window.orderBy("depth", "node")))
    return first.withColumn("truncated", F.max("__n").over(Window.partitionBy()) > limit).where(F.col("__n") <= limit).drop("__n")


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among nodes(node)."""
    n = nodes.select(F.col("node").alias("__n"))
    return edges.join(n, F.col("src") == F.col("__n"), "left_semi").join(n, F.col("dst") == F.col("__n"), "left_semi")


def path(edges: DataFrame, start: str, end: str, hops: int = 6, direction: str = "out", types: str | None = None) -> DataFrame:
    """step, src, dst, type, reverse of a shortest path, the least by its edges among several; no rows if there is none
    of at most `hops` edges. The walk goes from the end, so that every node reached knows its next one."""
    bounded(hops, 1, MAX_HOPS, "hops")
    spark = edges.sparkSession
    steps = _steps(of_types(edges, types), direction)
    with scratch(spark):
        found = _expanded(spark.createDataFrame([(end,)], "node string"), steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), hops)
        left = found.select(F.col("node").alias("src"), F.col("depth").alias("from_end"))
        right = found.select(F.col("node").alias("dst"), (F.col("depth") + 1).alias("from_end"))
        onward = stage(steps.join(left, "src").join(right, ["dst", "from_end"]).groupBy("src").agg(F.min(F.struct("dst", "type", "reverse")).alias("e")).select("src", "e.*"), "onward")
        out, at = [], start
        while at != end and len(out) < hops:  # one edge a step, at most `hops` of them
            e = onward.where(F.col("src") == at).first()
            if e is None:
                break
            out.append((len(out) + 1, at, e.dst, e.type, e.reverse))
            at = e.dst
    return spark.createDataFrame(out if at == end else [], "step int, src string, dst string, type string, reverse boolean")


def described(node: str, **tables: DataFrame) -> DataFrame:
    """table and row of the first table, in the order given, whose first column holds the node."""
    rows = [df.where(F.col(df.columns[0]) == node).select(F.lit(k).alias("k"), F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")) for k, (name, df) in enumerate(tables.items())]
    return reduce(DataFrame.union, rows).orderBy("k").limit(1).drop("k")


def identity(edges: DataFrame) -> DataFrame:
    """One digest of all edges: of buckets by the first four digits of the source node's digest, each over its ordered
    edges, then of each 256 buckets, then of those 256."""

    def joined(c: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(c, "d"))), lambda s: F.concat(s[c], F.lit(":"), s["d"])), "\n"), 256).alias("d")

    line = F.concat_ws("|", "src", "dst", "type")
    buckets = edges.select(F.substring(F.sha2("src", 256), 1, 4).alias("b"), line.alias("e")).groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("e")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    upper = buckets.groupBy(F.substring("b", 1, 2).alias("a")).agg(joined("b"), F.sum("n").alias("n"))
    return upper.agg(joined("a").alias("identity"), F.sum("n").alias("edges"))


def seeded(edges: DataFrame, seeds: DataFrame, hops: int = 4, limit: int = 500) -> DataFrame:
    """node, seed_rank, depth, contribution of nodes up to `hops` edges, of either direction, from seeds(node, rank):
    a node counts at its least depth for the best seed, 1 / (60 + rank + 10 * depth). At most `limit` nodes with the
    seeds, in the order of depth, rank and node; `truncated` marks every row if there were more."""
    bounded(hops, 0, 4, "hops")
    least = _expanded(seeds.groupBy("node").agg(F.min("rank").alias("seed_rank")), both_ways(edges).distinct(), hops)
    first = least.orderBy("depth", "seed_rank", "node").limit(limit + 1)
    order = Window.orderBy("depth", "seed_rank", "node")
    ranked = first.withColumn("__n", F.row_number().over(order)).withColumn("truncated", F.max("__n").over(Window.partitionBy()) > limit)
    return ranked.where(F.col("__n") <= limit).select("node", "seed_rank", "depth", (1 / (60 + F.col("seed_rank") + 10 * F.col("depth"))).alias("contribution"), "truncated")
