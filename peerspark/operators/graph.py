"""User graph: edges with the time they appear, degrees, components and pair flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .prefix import DEPTH_ROWS, bucket_width, running_number, running_total, state_at, time_bucket


def edges(inits: DataFrame, usps: DataFrame, drop_self_edges: bool = False) -> DataFrame:
    """Edge u -> author of each site u initiated with, from the later of the initiation and the
    author's first update. A site joins its initiators to its authors: the pairs are the edges
    asked for, and AQE splits a site that is hot on either side."""
    e = (inits.select(F.col("user_id").alias("src"), "site_id", "us")
         .join(usps.select(F.col("user_id").alias("dst"), "site_id", "exist_us"), "site_id")
         .groupBy("src", "dst").agg(F.min(F.greatest("us", "exist_us")).alias("edge_us")))
    return e.filter(F.col("src") != F.col("dst")) if drop_self_edges else e


def degrees_at(points: DataFrame, edge: DataFrame, user: str = "user_id") -> DataFrame:
    """Distinct in- and out-neighbours before each point's time (edges are distinct by pair)."""
    one = ("sum", F.lit(1).cast("long"))
    both = (edge.select(F.col("dst").alias(user), F.col("edge_us").alias("us"), F.lit(1).alias("i"), F.lit(0).alias("o"))
            .unionByName(edge.select(F.col("src").alias(user), F.col("edge_us").alias("us"),
                                     F.lit(0).alias("i"), F.lit(1).alias("o"))))
    return state_at(points, both, [user], {"indegree": ("sum", F.col("i").cast("long")),
                                           "outdegree": ("sum", F.col("o").cast("long"))}, depth=DEPTH_ROWS)


def components(edge: DataFrame, layer: list[str] | None = None) -> DataFrame:
    """Weakly connected components by alternating large-star and small-star contraction.

    ``edge`` has src, dst and optional ``layer`` columns; each layer is its own graph, solved in
    the same rounds. It ends after O(log^2 n) rounds, whatever n; a hub's neighbour list is never gathered,
    only its minimum (combined map-side). Returns (layer, node, component = smallest id).
    """
    layer = layer or []
    nodes = (edge.select(*layer, F.col("src").alias("node")).unionByName(edge.select(*layer, F.col("dst").alias("node")))
             .distinct())
    cur = cut_lineage(edge.filter(F.col("src") != F.col("dst"))
                      .select(*layer, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    stamp = None
    while True:
        both = cur.unionByName(cur.select(*layer, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*layer, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u point to the smallest id around u
        large = (both.join(low, [*layer, "u"]).filter(F.col("v") > F.col("u"))
                 .select(*layer, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its lower neighbours point to the smallest of them
        least = large.groupBy(*layer, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*layer, "u"]).select(
            *layer, F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = cut_lineage(small.select(*layer, "e.u", "e.v").filter(F.col("u") != F.col("v")).distinct())
        now = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v", *layer))).first()
        if now == stamp:
            break
        stamp = now
    parent = cur.groupBy(*layer, F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(parent, [*layer, "node"], "left").withColumn(
        "component", F.coalesce("component", "node"))


def component_sizes(comp: DataFrame, layer: list[str] | None = None) -> DataFrame:
    layer = layer or []
    size = comp.groupBy(*layer, "component").agg(F.count(F.lit(1)).alias("component_size"))
    return comp.join(size, [*layer, "component"])


def components_at(edge: DataFrame, at_us: int) -> DataFrame:
    """Components of the graph of edges before ``at_us`` with their sizes."""
    return component_sizes(components(edge.filter(F.col("edge_us") < at_us)))


def components_at_times(edge: DataFrame, wanted: DataFrame) -> DataFrame:
    """Component and its size for each wanted (node, us): the graph of edges before ``us``.

    Divide and conquer over the sorted distinct times: an interval of times is halved, the edges
    of its first half are contracted, the second half works on contracted nodes. All intervals of
    a level are layers of one ``components`` call, so each of the log2(#times) levels is one pass
    over the edges; a wanted row follows its own interval only. Sizes travel on edge endpoints.
    """
    rows, here, _ = _halved(edge, wanted)
    return _at_last(rows, here)


def _at_last(rows: DataFrame, here: DataFrame) -> DataFrame:
    return _apply(rows, _merged(here), "component", "component_size").select("node", "us", "component", "component_size")


def _halved(edge: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The halving of ``components_at_times`` down to single times: wanted rows and edges with ends that are contracted up to
    the time before, and the times by number (us, cut)."""
    times = cut_lineage(wanted.select("us").distinct())
    width = bucket_width(times, "us")
    cuts = cut_lineage(running_number(times, [], time_bucket("us", width), ["us"], "cut"))
    n_cuts = cuts.count()
    # an edge is first visible at the first time after it
    slot = state_at(edge.select("src", "dst", "edge_us"), cuts.select("us"), [], {"before": ("sum", F.lit(1).cast("long"))},
                    point_us="edge_us", bucket_us=bucket_width(edge, "edge_us"), inclusive=True)
    one = F.lit(1).cast("long")
    here = cut_lineage(slot.filter((F.col("src") != F.col("dst")) & (F.col("before") < n_cuts)).select(
        F.lit(0).cast("long").alias("part"), "src", "dst", F.col("before").alias("slot"),
        one.alias("src_size"), one.alias("dst_size")))
    rows = wanted.select("node", "us").distinct().join(cuts, "us").select(
        "node", "us", (F.col("cut") - 1).alias("slot"), F.lit(0).cast("long").alias("part"),
        F.col("node").alias("component"), one.alias("component_size"))
    width = 1
    while width < n_cuts:
        width *= 2
    while width > 1:
        half = width // 2
        late = (F.col("slot") % width) >= half
        first, second = here.filter(~late), here.filter(late)
        merged = cut_lineage(_merged(first))
        moved = _apply(rows.filter(late), merged, "component", "component_size")
        rows = cut_lineage(rows.filter(~late).withColumn("part", F.col("part") * 2)
                           .unionByName(moved.withColumn("part", F.col("part") * 2 + 1)))
        for end in ("src", "dst"):
            second = _apply(second, merged, end, f"{end}_size")
        here = cut_lineage(first.withColumn("part", F.col("part") * 2).unionByName(
            second.filter(F.col("src") != F.col("dst")).withColumn("part", F.col("part") * 2 + 1)))
        width = half
    return rows, here, cuts


@dataclass(frozen=True)
class History:
    """Components at all times of some (node, us), told by places: nodes are placed such that a component is a range at any time.

    ``places`` has (node, root, place), nodes that never have an edge left out. ``at`` has each wanted (node, us) with the
    ``component`` (its smallest node), ``component_size`` and, as root and [low, high), its range. ``growth`` has (us, root, low,
    high): from after ``us`` on the range is one component, until it grows again.
    """
    places: DataFrame
    at: DataFrame
    growth: DataFrame

    def sizes(self) -> DataFrame:
        """(node, us, component_size) whenever a node's component grows. As many rows as components have nodes whenever they grow."""
        each = self.growth.select("us", "root", F.explode(F.sequence("low", F.col("high") - 1)).alias("place"), (F.col("high") - F.col("low")).alias("component_size"))
        return each.join(self.places, ["root", "place"]).select("node", "us", "component_size")


def component_history(edge: DataFrame, wanted: DataFrame) -> History:
    """``components_at_times`` of the wanted rows with the places of all nodes.

    A component keeps its smallest node, so any other node is taken up once: the merge puts it behind the smaller ones
    that take part. Where a node lies from the last smallest node on is found by doubling along these merges.
    """
    rows, here, cuts = _halved(edge, wanted)
    at = cut_lineage(_at_last(rows, here))
    own = cut_lineage(_merged(here, own_size=True))
    behind = running_total(own, ["part", "component"], F.floor(F.col("node") / 1024).cast("long"), ["node"], "size", "_off")
    roots = own.select(F.col("component").alias("node")).join(own.filter("node <> component").select("node"), "node", "left_anti").distinct()
    way = cut_lineage(behind.filter("node <> component").select("node", F.col("component").alias("root"), F.coalesce("_off", F.lit(0)).cast("long").alias("place"))
                      .unionByName(roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("place"))))
    while True:
        up = way.select(F.col("node").alias("root"), F.col("root").alias("_up"), F.col("place").alias("_more"))
        further = cut_lineage(way.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("place") + F.col("_more")).alias("place"),
                                                          (F.col("_up") != F.col("root")).alias("_moved")))
        moved = not further.filter("_moved").isEmpty()
        way = further.drop("_moved")
        if not moved:
            break
    start = way.select(F.col("node").alias("component"), "root", F.col("place").alias("low"))
    ranged = lambda df, size: df.join(start, "component", "left").withColumns({
        "root": F.coalesce("root", "component"), "low": F.coalesce("low", F.lit(0).cast("long"))}).withColumn("high", F.col("low") + F.col(size))
    when = cuts.select((F.col("cut") - 1).alias("part"), (F.col("us") - 1).alias("us"))
    growth = ranged(own.select("part", "component", "total").distinct().join(when, "part"), "total").select("us", "root", "low", "high")
    return History(way, cut_lineage(ranged(at, "component_size")), cut_lineage(growth))


def _merged(part_edges: DataFrame, own_size: bool = False) -> DataFrame:
    """Components of each part's edges: (part, node, new component, its total size), with ``own_size`` also the node's before (size)."""
    comp = components(part_edges.select("part", "src", "dst"), ["part"])
    size = (part_edges.select("part", F.col("src").alias("node"), F.col("src_size").alias("size"))
            .unionByName(part_edges.select("part", F.col("dst").alias("node"), F.col("dst_size").alias("size"))).distinct())
    sized = comp.join(size, ["part", "node"])
    total = sized.groupBy("part", "component").agg(F.sum("size").alias("total"))
    return (sized if own_size else comp).join(total, ["part", "component"])


def _apply(df: DataFrame, merged: DataFrame, node: str, size: str) -> DataFrame:
    m = merged.select("part", F.col("node").alias(node), F.col("component").alias("_c"), "total")
    return df.join(m, ["part", node], "left").withColumns(
        {node: F.coalesce("_c", node), size: F.coalesce("total", size)}).drop("_c", "total").select(*df.columns)


def weakly_connected(pairs: DataFrame, edge: DataFrame, source: str = "source", target: str = "cand_user",
                     at: str = "us") -> DataFrame:
    """Flag: both users are in the same component before the pair's time."""
    wanted = pairs.select(F.col(source).alias("node"), F.col(at).alias("us")).unionByName(
        pairs.select(F.col(target).alias("node"), F.col(at).alias("us"))).distinct()
    comp = cut_lineage(components_at_times(edge, wanted))
    side = lambda c, n: comp.select(F.col("node").alias(c), F.col("us").alias(at), F.col("component").alias(n))
    same = (F.col("_s") == F.col("_t")) & (F.col(source) != F.col(target))
    return pairs.join(side(source, "_s"), [source, at]).join(side(target, "_t"), [target, at]).withColumn(
        "is_weakly_connected", same.cast("long")).drop("_s", "_t")


def reciprocal(pairs: DataFrame, edge: DataFrame, source: str = "source", target: str = "cand_user",
               at: str = "us") -> DataFrame:
    """Flag: the target had an edge to the source before the pair's time."""
    back = edge.select(F.col("dst").alias(source), F.col("src").alias(target), F.col("edge_us").alias("_e"))
    return pairs.join(back, [source, target], "left").withColumn(
        "is_reciprocal", F.coalesce((F.col("_e") < F.col(at)).cast("long"), F.lit(0).cast("long"))).drop("_e")


def _through(want: DataFrame, near: DataFrame, far: DataFrame, end: str, other: str, degree: str, part: int) -> DataFrame:
    """Paths of the wanted pairs over the edges of ``end``. A node's edges lie in parts of about ``part``, each of which
    meets the node's pairs on its own."""
    parts = F.ceil(F.col(degree) / part).cast("int")
    sizes = near.groupBy(end).agg(F.count(F.lit(1)).alias(degree))
    dealt = near.join(sizes, end).withColumn("_part", F.pmod(F.xxhash64("_mid"), parts).cast("int")).drop(degree)
    asked = want.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return asked.join(dealt, [end, "_part"]).join(far, ["_mid", other]).select("src", "dst", F.greatest("_a", "_b").alias("path_us"))


def two_hop_times(pairs: DataFrame, edge: DataFrame, source: str = "src", target: str = "dst", part: int = 4096) -> DataFrame:
    """Earliest time a 1- or 2-hop path source -> target is complete, for the given distinct pairs.

    A pair's middles are looked for among the edges of its end of lower degree, and confirmed by the exact
    edge to the other end: it costs the smaller of the two degrees, and a hub on one side costs nothing. The
    edges of a node that is heavy all the same are met in parts. Pairs with an end without edges have no path.
    """
    want = pairs.select(F.col(source).alias("src"), F.col(target).alias("dst")).distinct()
    n_out = edge.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
    n_in = edge.groupBy("dst").agg(F.count(F.lit(1)).alias("_in"))
    sized = want.join(n_out, "src").join(n_in, "dst")
    out = edge.select("src", F.col("dst").alias("_mid"), F.col("edge_us").alias("_a"))
    inn = edge.select(F.col("src").alias("_mid"), "dst", F.col("edge_us").alias("_b"))
    lean = F.col("_out") <= F.col("_in")
    two = _through(sized.filter(lean).drop("_in"), out, inn, "src", "dst", "_out", part).unionByName(
        _through(sized.filter(~lean).drop("_out"), inn, out, "dst", "src", "_in", part))
    one = want.join(edge.select("src", "dst", F.col("edge_us").alias("path_us")), ["src", "dst"])
    return (one.unionByName(two).groupBy(F.col("src").alias(source), F.col("dst").alias(target))
            .agg(F.min("path_us").alias("path_us")))


def mutual_fof(pairs: DataFrame, edge: DataFrame, source: str = "source", target: str = "cand_user",
               at: str = "us") -> DataFrame:
    """Flag: source reaches target and target reaches source within two hops before the time."""
    keys = pairs.select(source, target).distinct()
    both = keys.select(F.col(source).alias("src"), F.col(target).alias("dst")).unionByName(
        keys.select(F.col(target).alias("src"), F.col(source).alias("dst"))).distinct()
    hop = two_hop_times(both, edge)
    there = hop.select(F.col("src").alias(source), F.col("dst").alias(target), F.col("path_us").alias("_f"))
    back = hop.select(F.col("dst").alias(source), F.col("src").alias(target), F.col("path_us").alias("_b"))
    when = keys.join(there, [source, target]).join(back, [source, target]).select(
        source, target, F.greatest("_f", "_b").alias("_m"))
    return pairs.join(when, [source, target], "left").withColumn(
        "is_mutual_fof", F.coalesce((F.col("_m") < F.col(at)).cast("long"), F.lit(0).cast("long"))).drop("_m")


def mutual_fof_times(sources: DataFrame, edge: DataFrame) -> DataFrame:
    """All users that a source reaches and is reached from within two hops: (source, cand_user) and the time both hold (us)."""
    first = edge.join(sources.select(F.col("source").alias("src")).distinct(), "src", "left_semi")
    on = edge.select(F.col("src").alias("_mid"), F.col("dst").alias("_to"), F.col("edge_us").alias("_b"))
    two = first.select("src", F.col("dst").alias("_mid"), F.col("edge_us").alias("_a")).join(on, "_mid").select(
        "src", F.col("_to").alias("dst"), F.greatest("_a", "_b").alias("_f"))
    there = cut_lineage(first.select("src", "dst", F.col("edge_us").alias("_f")).unionByName(two).filter("src <> dst")
                        .groupBy("src", "dst").agg(F.min("_f").alias("_f")))
    back = two_hop_times(there.select(F.col("dst").alias("src"), F.col("src").alias("dst")), edge).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("path_us").alias("_b"))
    return there.join(back, ["src", "dst"]).select(F.col("src").alias("source"), F.col("dst").alias("cand_user"), F.greatest("_f", "_b").alias("us"))
