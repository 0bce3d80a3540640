"""Nearest-point joins in the plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epispark.functions.stats import selected_quantiles
from epispark.operators.lineage import cut

#: Boxes that one level of the tree sends to all tasks at most (each 40 bytes); levels with more are joined.
SENT = 1 << 16


def split_tree(places: DataFrame, per_leaf: int, fan: int = 8) -> tuple[DataFrame, int]:
    """Points (p, px, py) with ``node_0`` ... ``node_k``, their boxes in a tree split by counts; and k.

    Each level cuts every box that holds more than ``per_leaf`` points into ``fan`` parts of equally many, across its longer
    side, whatever the spread. Cuts come from ``percentile_approx``, whose state a box is bounded; points on a cut go to the part
    above it. Places are distinct, so a box of more than one point has a longer side and falls apart; where the cuts are all at its low
    end, it is cut at the middle. Each level is cut off its lineage, so that all that read it see the same boxes.
    """
    level, rows = 0, cut(places.withColumn("node_0", F.lit(0).cast("bigint")))
    while True:
        node = f"node_{level}"
        boxes = rows.groupBy(node).agg(F.count(F.lit(1)).alias("n"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
        boxes = boxes.withColumn("by_x", (F.col("x1") - F.col("x0")) >= (F.col("y1") - F.col("y0")))
        side = lambda k: F.when(F.col("by_x"), F.col(f"x{k}")).otherwise(F.col(f"y{k}"))
        large = boxes.filter(F.col("n") > per_leaf).select(node, "by_x", side(0).alias("low"), side(1).alias("high"))
        if large.isEmpty():
            return rows, level
        along = F.when(F.col("by_x"), F.col("px")).otherwise(F.col("py"))
        marked = rows.join(large, node)
        shares = F.array(*[F.lit(i / fan) for i in range(1, fan)])
        cuts = marked.groupBy(node).agg(F.percentile_approx(along, shares, 1000).alias("cuts"))
        # a part below a cut must not be empty for all of them
        cuts = large.join(cuts, node).withColumn("cuts", F.filter(F.array_distinct("cuts"), lambda c: c > F.col("low")))
        middle = F.col("low") / 2 + F.col("high") / 2
        cuts = cuts.withColumn("cuts", F.when(F.size("cuts") == 0, F.array(F.when(middle > F.col("low"), middle).otherwise(F.col("high")))).otherwise(F.col("cuts")))
        level += 1
        child = F.xxhash64(node, F.coalesce(F.size(F.filter("cuts", lambda c: c <= along)), F.lit(0)))
        rows = cut(rows.join(cuts.select(node, "by_x", "cuts"), node, "left").withColumn(f"node_{level}", child).drop("by_x", "cuts"))


def candidates(places: DataFrame, placed: DataFrame, depth: int) -> DataFrame:
    """(x, y, p, px, py): for each of the distinct places (x, y) the points in the leaves that may hold its nearest one."""
    kept = places.withColumn("node", F.lit(0).cast("bigint"))
    by_query = Window.partitionBy("x", "y")
    for level in range(1, depth + 1):
        boxes = placed.groupBy(f"node_{level - 1}", f"node_{level}").agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
        boxes = boxes.withColumnsRenamed({f"node_{level - 1}": "node", f"node_{level}": "inner"})
        inside = kept.join(F.broadcast(boxes) if 8**level <= SENT else boxes, "node")
        sides = {v: (F.abs(F.col(v) - F.col(f"{v}0")), F.abs(F.col(v) - F.col(f"{v}1"))) for v in "xy"}
        near = sum(F.pow(F.greatest(F.col(f"{v}0") - F.col(v), F.col(v) - F.col(f"{v}1"), F.lit(0.0)), 2) for v in "xy")
        # the nearer of two opposite sides has a point, which is no farther away than that side's farther end
        reach = F.least(*[F.pow(F.least(*sides[a]), 2) + F.pow(F.greatest(*sides[b]), 2) for a, b in ("xy", "yx")])
        judged = inside.withColumns({"near": near, "reach": F.min(reach).over(by_query)})
        kept = judged.filter(F.col("near") <= F.col("reach") * (1 + 1e-9)).select("x", "y", F.col("inner").alias("node"))
    return kept.join(placed.select("p", "px", "py", F.col(f"node_{depth}").alias("node")), "node")


def nearest_join(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, x: str = "lon", y: str = "lat", per_leaf: int = 16) -> DataFrame:
    """(query_id, point_id, distance): each query's nearest point, however far, ties to the lowest id.

    Points at one place are merged to the lowest id. A tree that is split by counts (``split_tree``) ends in leaves of ``per_leaf`` points at most,
    wherever they are. A query goes down level by level: of the boxes inside those that it has kept, it keeps those that may hold its
    nearest point, which is no farther away than the side of any box that is farthest from it (each side of a tight box has a point).
    In the leaves it meets the points. Queries at one place go down once. All joins are equi-joins. Queries or points
    without (finite) coordinates are left out; without points there are no rows. Rows that repeat a query's id have one
    result each if they are at different places.
    """
    finite = lambda *names: " and ".join(f"{n} is not null and not isnan({n}) and abs({n}) < double('infinity')" for n in names)
    left = queries.select(F.col(query_id).alias("q"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(finite("x", "y"))
    right = points.select(F.col(point_id).alias("p"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).filter(finite("px", "py"))
    placed, depth = split_tree(right.groupBy("px", "py").agg(F.min("p").alias("p")), per_leaf)
    met = candidates(left.select("x", "y").distinct(), placed, depth)
    d2 = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    best = met.groupBy("x", "y").agg(F.min(F.struct(d2.alias("d2"), F.col("p").alias("p"))).alias("best"))
    return left.distinct().join(best, ["x", "y"]).select(F.col("q").alias(query_id), F.col("best.p").alias(point_id), F.sqrt("best.d2").alias("distance"))


def distance_audit(joined: DataFrame, limit: float = 0.5) -> DataFrame:
    """Quantiles of the distances, and how many are above ``limit``."""
    distances = joined.select("distance").persist()
    try:
        q = selected_quantiles(distances, "distance", [0.5, 0.9, 0.95, 1.0])
        n = distances.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") > limit).alias("far")).first()
    finally:
        distances.unpersist()
    return joined.sparkSession.createDataFrame([(n["n"], *q, n["far"])], "n bigint, p50 double, p90 double, p95 double, max double, n_far bigint")
