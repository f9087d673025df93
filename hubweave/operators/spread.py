"""Graph operators that spread along edges, on all networks at once: joins keyed by network, repeated to a fixed point.

Edge tables are (key, src, dst, w) with src < dst. No network is gathered whole: a network's edges, labels, distances
and tree are rows, and the rounds of all networks run together, so their number grows with the longest way in any of
them (or its logarithm) and not with the number of networks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubweave.operators.graph_metrics import KEY, doubled
from hubweave.sources.scratch import settled

PLACES = 9  # decimals to which values that are compared have to agree


def components(edges: DataFrame, key=KEY) -> DataFrame:
    """(key, node, component) of the nodes that have an edge: the smallest node reachable.

    A round gives every label the smallest label among all neighbours of its nodes, and then each node the label of
    its label, so that labels merge like trees that are hooked to each other: the rounds grow with the logarithm of
    the nodes, for long chains too.
    """
    both = settled(doubled(edges, key).select(*key, "node", "other").distinct())
    labels = both.groupBy(*key, "node").agg(F.least("node", F.min("other")).alias("component"))

    def moved(known: DataFrame) -> DataFrame:
        ends = both.join(known.withColumnRenamed("component", "own"), [*key, "node"]).join(known.select(*key, F.col("node").alias("other"), F.col("component").alias("near")), [*key, "other"])
        lowest = ends.groupBy(*key, F.col("own").alias("component")).agg(F.min("near").alias("near"))
        hooked = known.join(lowest, [*key, "component"]).select(*key, "node", F.least("component", "near").alias("component"))
        further = hooked.select(*key, F.col("component").alias("further"), F.col("node").alias("component"))
        return hooked.join(further, [*key, "component"]).select(*key, "node", F.least("component", "further").alias("component"))

    while True:
        once = moved(labels)
        twice = moved(once)
        step = settled(twice.join(once.withColumnRenamed("component", "was"), [*key, "node"]))
        labels = step.drop("was")
        if step.where("component <> was").isEmpty():
            return labels


def all_components(edges: DataFrame, nodes: DataFrame, key=KEY) -> DataFrame:
    """components() of all ``nodes`` (key, node); one without an edge is its own."""
    return nodes.join(components(edges, key), [*key, "node"], "left").select(*key, "node", F.coalesce("component", "node").alias("component"))


def _roots(parents: DataFrame, key) -> DataFrame:
    """(key, tree, root) of pointers (key, tree, to) whose only cycles are pairs: the smaller of the pair at the end."""
    back = parents.select(*key, F.col("tree").alias("to"), F.col("to").alias("back"))
    at = parents.join(back, [*key, "to"], "left").select(*key, "tree", F.when((F.col("back") == F.col("tree")) & (F.col("tree") < F.col("to")), F.col("tree")).otherwise(F.col("to")).alias("root"))

    def jumped(known: DataFrame) -> DataFrame:
        further = known.select(*key, F.col("tree").alias("root"), F.col("root").alias("next"))
        return known.join(further, [*key, "root"]).select(*key, "tree", F.col("next").alias("root"))

    while True:
        once = jumped(jumped(at))
        step = settled(jumped(once).join(once.withColumnRenamed("root", "was"), [*key, "tree"]))
        at = step.drop("was")
        if step.where("root <> was").isEmpty():
            return at


def spanning_forest(edges: DataFrame, key=KEY, largest: bool = False) -> DataFrame:
    """(key, src, dst, w, turn) of the minimum (or maximum) spanning forest by (w, src, dst): Boruvka's rounds.

    In a round every tree takes its cheapest edge that leaves it and points to the tree at its other end; trees are
    renamed by where the pointers end, and edges inside a tree go. ``turn`` is the round. The number of trees at least
    halves each time.
    """
    weight = -F.col("w") if largest else F.col("w")
    left = settled(edges.select(*key, "src", "dst", "w", weight.alias("cost"), F.col("src").alias("a"), F.col("dst").alias("b")))
    taken, turn = [edges.select(*key, "src", "dst", "w", F.lit(0).alias("turn")).limit(0)], 0
    while not left.isEmpty():
        turn += 1
        order = F.struct("cost", "src", "dst", "w")
        ends = left.select(*key, F.col("a").alias("tree"), F.col("b").alias("to"), order.alias("edge")).unionByName(left.select(*key, F.col("b").alias("tree"), F.col("a").alias("to"), order.alias("edge")))
        chosen = settled(ends.groupBy(*key, "tree").agg(F.min("edge").alias("edge"), F.min_by("to", "edge").alias("to")))
        taken.append(chosen.select(*key, "edge.src", "edge.dst", "edge.w", F.lit(turn).alias("turn")).distinct())
        roots = _roots(chosen.select(*key, "tree", "to"), key)
        for end in ("a", "b"):
            left = left.join(roots.withColumnRenamed("tree", end), [*key, end]).drop(end).withColumnRenamed("root", end)
        left = settled(left.where("a <> b"))
    return reduce(DataFrame.unionByName, taken)


def distances(edges: DataFrame, nodes: DataFrame, key=KEY, hops: bool = False) -> DataFrame:
    """(key, a, b, d) for a <> b that are connected, both ways: shortest path lengths, weights (or hops) as lengths.

    Min-plus products of the table with itself, so a round doubles the number of edges that a path may have.
    """
    length = F.lit(1.0) if hops else F.col("w")
    known = settled(doubled(edges.withColumn("w", length), key).select(*key, F.col("node").alias("a"), F.col("other").alias("b"), F.col("w").alias("d")))
    while True:
        onward = known.select(*key, F.col("a").alias("via"), F.col("b").alias("end"), F.col("d").alias("more"))
        longer = known.withColumnRenamed("b", "via").join(onward, [*key, "via"]).where("a <> end").groupBy(*key, "a", F.col("end").alias("b")).agg(F.min(F.col("d") + F.col("more")).alias("new"))
        step = settled(longer.join(known, [*key, "a", "b"], "full").select(*key, "a", "b", F.least("d", "new").alias("d"), (F.col("d").isNull() | (F.col("new") < F.col("d") - F.lit(1e-12))).alias("moved")))
        known = step.drop("moved")
        if step.where("moved").isEmpty():
            return known


def path_metrics(edges: DataFrame, nodes: DataFrame, key=KEY, hops: bool = False) -> tuple[DataFrame, DataFrame]:
    """((key, connected, path_length, diameter), (key, node, closeness)) of networks with ``nodes`` (key, node).

    Mean and longest of the shortest paths; a network in several pieces has an infinite mean, diameter 0 and closeness 0.
    """
    d = distances(edges, nodes, key, hops)
    size = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    per = size.join(d.groupBy(*key).agg(F.sum("d").alias("total"), F.max("d").alias("longest"), F.count(F.lit(1)).alias("pairs")), list(key), "left")
    whole = F.coalesce(F.col("pairs"), F.lit(0)) == F.col("n") * (F.col("n") - 1)
    several = whole & (F.col("n") > 1)
    networks = per.select(*key, whole.alias("connected"), F.when(several, F.col("total") / F.col("pairs")).otherwise(F.lit(float("inf"))).alias("path_length"), F.when(several, F.col("longest")).otherwise(F.lit(0.0)).alias("diameter"))
    far = nodes.join(d.groupBy(*key, F.col("a").alias("node")).agg(F.sum("d").alias("far")), [*key, "node"], "left")
    close = far.join(per.select(*key, "n", several.alias("several")), list(key)).select(*key, "node", F.when(F.col("several"), F.try_divide(F.col("n") - F.lit(1.0), F.col("far"))).otherwise(F.lit(0.0)).alias("closeness"))
    return networks, close


TIE = 1e-10  # lengths that differ by less are equal


def betweenness(edges: DataFrame, nodes: DataFrame, key=KEY, hops: bool = False) -> tuple[DataFrame, DataFrame]:
    """((key, node, betweenness), (key, src, dst, w, betweenness)): shares of the shortest paths between all pairs.

    Nodes are normalised by the pairs of other nodes, edges are not; each pair counts once. The number of shortest
    paths n(s, t) is that of the ways to the last node before t, summed over the edges into t that lie on one, from
    direct edges on to the longest path. A node v on the way from s stands for the paths to all t beyond (and to v
    itself): dependency(s, v) = sum of n(s, v) n(v, t) / n(s, t); an edge from u into v has the share n(s, u) / n(s, v).
    """
    length = F.lit(1.0) if hops else F.col("w")
    d = distances(edges, nodes, key, hops)
    both = doubled(edges.withColumn("w", length), key)
    own = d.select(*key, F.col("a").alias("s")).distinct().select(*key, "s", F.col("s").alias("u"), F.lit(0.0).alias("du"))
    starts = own.unionByName(d.select(*key, F.col("a").alias("s"), F.col("b").alias("u"), F.col("d").alias("du")))
    into = both.select(*key, F.col("node").alias("u"), F.col("other").alias("v"), "w")
    ends = d.select(*key, F.col("a").alias("s"), F.col("b").alias("v"), F.col("d").alias("dv"))
    last = settled(starts.join(into, [*key, "u"]).where("s <> v").join(ends, [*key, "s", "v"]).where(F.abs(F.col("du") + F.col("w") - F.col("dv")) <= TIE).select(*key, "s", "u", "v"))
    paths = settled(d.select(*key, F.col("a").alias("s"), F.col("b").alias("v"), F.lit(0.0).alias("n")))
    while True:
        ways = last.join(paths.select(*key, "s", F.col("v").alias("u"), F.col("n").alias("before")), [*key, "s", "u"], "left").groupBy(*key, "s", "v").agg(F.sum(F.when(F.col("u") == F.col("s"), F.lit(1.0)).otherwise(F.coalesce("before", F.lit(0.0)))).alias("ways"))
        step = settled(paths.join(ways, [*key, "s", "v"]).select(*key, "s", "v", F.col("ways").alias("n"), (F.col("ways") != F.col("n")).alias("moved")))
        paths = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    known = settled(paths.join(ends, [*key, "s", "v"]).select(*key, "s", "v", "n", F.col("dv").alias("d")))
    onward = known.select(*key, F.col("s").alias("v"), F.col("v").alias("t"), F.col("n").alias("n2"), F.col("d").alias("d2"))
    whole = known.select(*key, "s", F.col("v").alias("t"), F.col("n").alias("n3"), F.col("d").alias("d3"))
    on = known.join(onward, [*key, "v"]).where("s <> t").join(whole, [*key, "s", "t"]).where(F.abs(F.col("d") + F.col("d2") - F.col("d3")) <= TIE)
    through = on.groupBy(*key, "s", "v").agg(F.sum(F.col("n") * F.col("n2") / F.col("n3")).alias("beyond"))
    depends = settled(known.join(through, [*key, "s", "v"], "left").select(*key, "s", "v", "n", F.coalesce("beyond", F.lit(0.0)).alias("beyond")))
    size = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    sums = depends.groupBy(*key, F.col("v").alias("node")).agg((F.sum("beyond") / 2).alias("sum"))
    pairs = (F.col("size") - 1) * (F.col("size") - 2) / 2
    per_node = nodes.join(sums, [*key, "node"], "left").join(size, list(key)).select(*key, "node", F.coalesce(F.try_divide("sum", pairs), F.lit(0.0)).alias("betweenness"))
    before = depends.select(*key, "s", F.col("v").alias("u"), F.col("n").alias("nu"))
    share = F.when(F.col("u") == F.col("s"), F.lit(1.0)).otherwise(F.col("nu")) / F.col("n") * (F.col("beyond") + 1)
    used = last.join(depends, [*key, "s", "v"]).join(before, [*key, "s", "u"], "left").groupBy(*key, F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg((F.sum(share) / 2).alias("betweenness"))
    per_edge = edges.select(*key, "src", "dst", "w").join(used, [*key, "src", "dst"], "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    return per_node, per_edge


SQUARINGS = 2  # in one job
ROUNDS = 10


def eigenvector(edges: DataFrame, nodes: DataFrame, key=KEY, tolerance: float = 1e-11) -> DataFrame:
    """(key, node, eigenvector) of all ``nodes`` (key, node): the leading eigenvector of the weights, largest entry 1.

    Power iteration by squaring: each connected component's matrix, a row of weights per node, is joined with itself by
    the component's name and multiplied, so m products stand for 2^m steps and the slowest component needs some twenty.
    The matrix tends to the product of its leading eigenvector with itself; a component that changes by no more than
    ``tolerance`` leaves the loop (SQUARINGS x ROUNDS products at most). Rows are dealt out by component and stay there.

    Components are iterated apart, so that none has to die out; the one with the largest eigenvalue counts (to 9
    decimals; of equal ones that of the smallest node), nodes of the others are 0, as are all nodes of a network without
    edges. A quarter of the mean strength on the diagonal lets two-sided components settle too.
    """
    label = components(edges, key)
    name = F.concat_ws("\x01", *[F.col(k).cast("string") for k in key], "component")
    place = F.row_number().over(Window.partitionBy(*key, "component").orderBy("node")) - 1
    placed = settled(label.select(*key, "node", "component", name.alias("net"), place.alias("at")))
    near = doubled(edges, key).join(placed.select(*key, "node", "net", "at"), [*key, "node"]).join(placed.select(*key, F.col("node").alias("other"), F.col("at").alias("to")), [*key, "other"])
    weights = settled(near.select("net", "at", "to", "w"))
    sizes = weights.groupBy("net").agg(F.countDistinct("at").cast("int").alias("size"), F.sum("w").alias("all"))
    sparse = weights.groupBy("net", "at").agg(F.map_from_entries(F.collect_list(F.struct("to", "w"))).alias("near")).join(sizes, "net")
    cell = lambda k: F.when(k == F.col("at"), F.col("all") / F.col("size") / 4).otherwise(F.coalesce(F.try_element_at("near", k), F.lit(0.0)))
    state = sparse.select("net", "at", F.transform(F.sequence(F.lit(0), F.col("size") - 1), cell).alias("row"), F.lit(1.0).alias("v"))
    parts = edges.sparkSession.sparkContext.defaultParallelism
    dot = F.aggregate(F.zip_with("row", "other", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    found = []
    for turn in range(ROUNDS):
        now = state.repartition(parts, "net")
        for _ in range(SQUARINGS):
            met = now.hint("merge").join(now.select("net", F.col("at").alias("to"), F.col("row").alias("other")), "net")
            rows = met.groupBy("net", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("to", dot.alias("x")))), lambda c: c["x"]).alias("row"), F.first("v").alias("was"))
            by = Window.partitionBy("net")
            top = F.max(F.struct(F.get("row", F.col("at")).alias("x"), "at")).over(by)
            now = rows.withColumn("top", top).select("net", "at", F.transform("row", lambda x: x / F.col("top.x")).alias("row"), "was", (F.get("row", F.col("top.at")) / F.col("top.x")).alias("v"))
        step = settled(now.withColumn("done", F.max(F.abs(F.col("v") - F.col("was"))).over(Window.partitionBy("net")) <= tolerance))
        last = turn + 1 == ROUNDS
        found.append(step.where(F.col("done") | F.lit(last)).select("net", "at", "v"))
        state = step.where("not done").select("net", "at", "row", "v")
        if last or state.isEmpty():
            break
    values = settled(reduce(DataFrame.unionByName, found))
    both = weights.join(values, ["net", "at"]).join(values.select("net", F.col("at").alias("to"), F.col("v").alias("u")), ["net", "to"])
    norm = values.groupBy("net").agg(F.sum(F.col("v") * F.col("v")).alias("norm"))
    power = both.groupBy("net").agg(F.sum(F.col("w") * F.col("u") * F.col("v")).alias("power")).join(norm, "net").select("net", F.round(F.col("power") / F.col("norm"), PLACES).alias("value"))
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("value").desc(), "component"))
    leads = placed.where("at = 0").join(power, "net").withColumn("place", best).where("place = 1").select("net")
    entry = placed.join(values.join(leads, "net"), ["net", "at"]).select(*key, "node", F.col("v").alias("eigenvector"))
    return nodes.join(entry, [*key, "node"], "left").select(*key, "node", F.coalesce("eigenvector", F.lit(0.0)).alias("eigenvector"))
