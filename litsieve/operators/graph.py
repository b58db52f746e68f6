"""Graph operators on edge tables: connected components and local clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.storage import drop, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)``: the smallest node id that each node of the edge table can reach.

    Alternating large-star and small-star passes (Kiveris et al., "Connected Components in MapReduce
    and Beyond"): every pass is one partial aggregation and one join, the number of passes is
    logarithmic for star-like groups, and no pass holds a component in one task. The edge set is
    written to the shared folder after each round, so a lost executor repeats one round at most.
    Null ends, self loops and repeated edges are ignored.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialize(e, "cc")
    before = None
    for _ in range(max_rounds):
        last, e = e, materialize(_small_star(_large_star(e)), "cc")
        drop(last)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("v")).first()
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    d = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = d.groupBy("u").agg(F.min("v").alias("m"))
    down = d.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def local_clustering(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, degree, triangles, clustering)``: 2T / (d (d - 1)), 0 where d < 2.

    Edges are oriented from the end of lower degree to the other, which bounds every node's
    out-degree by sqrt(2 E) and so the wedges that the join makes.
    """
    e = (
        edges.where(F.col(src) != F.col(dst))
        .select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
        .distinct()
    )
    degree = e.select(F.col("a").alias("node")).union(e.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    da = degree.select(F.col("node").alias("a"), F.col("degree").alias("da"))
    db = degree.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    o = (
        e.join(da, "a")
        .join(db, "b")
        .select(
            F.when(F.struct("da", "a") < F.struct("db", "b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("e")
        )
        .select(F.col("e.a").alias("x"), F.col("e.b").alias("y"))
    )
    wedge = o.alias("p").join(o.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    tri = wedge.join(e.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    per = tri.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = F.col("degree")
    t = F.coalesce("triangles", F.lit(0).cast("long"))
    return degree.join(per, "node", "left").select(
        "node", "degree", t.alias("triangles"), F.when(d < 2, F.lit(0.0)).otherwise(2.0 * t / (d * (d - 1))).alias("clustering")
    )


def minimum_spanning_forest(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "dist", max_rounds: int = 60) -> DataFrame:
    """``a < b, dist``: the minimum spanning forest by Boruvka's rounds over the edge table.

    In a round each component takes its least edge, components that such edges link become one, and of the edges between
    two components the least stays. Edges are ordered by weight and then by their ends, so that no round closes a cycle and
    ties give one result. Components at least halve, so rounds are logarithmic; minima are partial aggregates, so a node with a third of
    all edges is combined before it is shuffled. Null ends or weights and self loops are ignored; an empty table gives no rows.
    """
    e = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), F.col(weight).cast("double").alias("dist"))
    e = e.where("a is not null and b is not null and dist is not null and a <> b").groupBy("a", "b").agg(F.min("dist").alias("dist"))
    e = materialize(e.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("dist", "a", "b").alias("e")), "msf")
    taken: DataFrame | None = None
    for _ in range(max_rounds):
        ends = e.select("u", "v", "e").union(e.select("v", "u", "e"))
        least = materialize(ends.groupBy("u").agg(F.min_by(F.struct("e", "v"), "e").alias("x")).select("u", "x.v", "x.e"), "msf-least")
        if least.isEmpty():
            drop(e)
            break
        chosen = least.select("e").distinct()
        taken = chosen if taken is None else taken.union(chosen)
        near = materialize(connected_components(least, "u", "v"), "msf-components")
        to = lambda name: near.select(F.col("node").alias(name), F.col("component").alias(f"{name}_to"))  # noqa: E731, B023
        moved = e.join(to("u"), "u").join(to("v"), "v").where("u_to <> v_to")
        pair = moved.groupBy(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v")).agg(F.min("e").alias("e"))
        last, e = e, materialize(pair, "msf")
        drop(last)
        drop(near)
    else:
        raise RuntimeError(f"the forest did not settle in {max_rounds} rounds")
    return (taken if taken is not None else least.select("e")).select("e.a", "e.b", "e.dist")


def components_at(forest: DataFrame, nodes: DataFrame, limits: list[float]) -> DataFrame:
    """``step, component, size`` of the components of edges shorter than each limit; ``step`` is the limit's place.

    ``forest`` is a minimum spanning forest (``a, b, dist``), which has the components of its whole graph at every limit.
    ``nodes``: ``node, size``. All limits are settled by one run over (limit, node), as a forest has fewer edges than nodes;
    names of components are numbers without a meaning.
    """
    from litsieve.schema import numbered

    at = materialize(numbered(nodes.select("node", "size"), ["node"], "id"), "forest-nodes")
    n = at.count()
    steps = F.array(*[F.lit(float(t)) for t in limits]) if limits else F.array().cast("array<double>")
    name = lambda c: at.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    numbered_edges = forest.join(name("a"), "a").join(name("b"), "b")
    each = numbered_edges.select("a_id", "b_id", "dist", F.posexplode(steps).alias("step", "limit")).where("dist < limit")
    e = each.select((F.col("step") * n + F.col("a_id")).alias("src"), (F.col("step") * n + F.col("b_id")).alias("dst"))
    near = connected_components(e)
    every = at.select("id", "size", F.posexplode(steps).alias("step", "limit")).select("step", "size", (F.col("step") * n + F.col("id")).alias("node"))
    return every.join(near, "node", "left").groupBy("step", F.coalesce("component", "node").alias("component")).agg(F.sum("size").alias("size"))
