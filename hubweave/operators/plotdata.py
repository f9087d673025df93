"""The tables behind the plots: rankings, bins, histograms, quartiles, regressions, area means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubweave.functions.stats import average_rank, safe_corr


def top(table: DataFrame, value: str, n: int, *by: str) -> DataFrame:
    """The n rows of highest value of each group, with their place; ties by node."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), "node"))
    return table.withColumn("place", place).where(F.col("place") <= n)


def hub_regions(consensus: DataFrame, *by: str, at: float = 0.6) -> DataFrame:
    """(by, region, n): nodes in each of the seven regions of the three approaches' hub sets, named by W, P and S."""
    region = F.concat(*[F.when(F.col(f"{a}_prob") >= at, F.lit(c)).otherwise(F.lit("")) for a, c in (("weighted", "W"), ("percolation", "P"), ("persistence", "S"))])
    return consensus.withColumn("region", region).where("region <> ''").groupBy(*by, "region").agg(F.count(F.lit(1)).alias("n"))


def histogram(table: DataFrame, value: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by, bin, n): counts of equal bins, the first 1; values outside the range fall in the end bins. A value within
    9 decimals of an edge is on it."""
    at = F.least(F.greatest(F.floor(F.round((F.col(value) - low) / (high - low) * bins, 9)) + 1, F.lit(1)), F.lit(bins)).cast("int")
    return table.where(F.col(value).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(table: DataFrame, value: str, *by: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = table.groupBy(*by).agg(q.alias("q"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return s.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "sd")


def area_means(table: DataFrame, value: str, areas: DataFrame, *by: str) -> DataFrame:
    """(by, area, mean, se, n)."""
    s = table.join(F.broadcast(areas), "node").groupBy(*by, "area").agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))
    return s


def regression(table: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, slope, intercept, r)."""
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return table.groupBy(*by).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"), safe_corr(x, y).alias("r"))


def inverted_ranks(table: DataFrame, value: str, *by: str) -> DataFrame:
    """Adds (n - rank + 1) / n, average ranks of falling values."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return table.withColumn("inverted_rank", (n - average_rank(value, *by, descending=True) + 1) / n)


def agreement_bins(consensus: DataFrame, *by: str) -> DataFrame:
    """(by, bin, n): scores in thirds, right ends included."""
    b = F.when(F.col("score") <= 0.33, "low").when(F.col("score") <= 0.66, "middle").otherwise("high")
    return consensus.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def symmetric(pairs: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, a, b, value): a pair list (g1, g2) as the cells of its symmetric matrix, 1 on the diagonal."""
    listed = pairs.select(*by, F.col("g1").alias("a"), F.col("g2").alias("b"), value)
    cells = listed.union(listed.select(*by, "b", "a", value))
    return cells.union(cells.select(*by, "a").distinct().select(*by, "a", F.col("a").alias("b"), F.lit(1.0)))


def extremes(table: DataFrame, value: str, n: int, *by: str) -> DataFrame:
    """The n lowest and the n highest rows of each group, by ``side`` and place; ties by node."""
    group = Window.partitionBy(*by)
    low = F.row_number().over(group.orderBy(F.col(value).asc_nulls_last(), "node"))
    high = F.row_number().over(group.orderBy(F.col(value).desc_nulls_last(), "node"))
    placed = table.select(*by, "node", value, low.alias("low"), high.alias("high"))
    return placed.unpivot([*by, "node", value], ["low", "high"], "side", "place").where(F.col("place") <= n)


def mean_ranks_of_areas(standardised: DataFrame, areas: DataFrame, *by: str) -> DataFrame:
    """(by, area, mean_rank): nodes ranked by their mean z over methods and approaches, 1 the highest, averaged by area."""
    means = standardised.groupBy(*by, "node").agg(F.round(F.avg("z"), 9).alias("z"))
    ranked = means.withColumn("rank", average_rank("z", *by, descending=True))
    return ranked.join(F.broadcast(areas), "node").groupBy(*by, "area").agg(F.avg("rank").alias("mean_rank"))


def average_network(corr: DataFrame) -> DataFrame:
    """(method, i, j, w): the mean network of all groups, cut at the median of its weights above 0."""
    mean = corr.groupBy("method", "i", "j").agg(F.avg(F.abs("r")).alias("w"))
    cut = mean.where("w > 0").groupBy("method").agg(F.median("w").alias("cut"))
    return mean.join(cut, "method").where("w > cut").drop("cut")


def dual_network(corr: DataFrame, first: str, second: str) -> DataFrame:
    """(method, i, j, found): edges of two groups, each cut at its median weight (to 9 decimals); found in both, the first
    or the second."""
    edges = corr.where(F.col("grp").isin(first, second)).select("method", "grp", "i", "j", F.round(F.abs("r"), 9).alias("w"))
    cut = edges.where("w > 0").groupBy("method", "grp").agg(F.median("w").alias("cut"))
    kept = edges.join(cut, ["method", "grp"]).where("round(w - cut, 9) > 0")
    sides = kept.groupBy("method", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("grp"))
    return sides.select("method", "i", "j", F.when(F.col("n") == 2, "both").when(F.col("grp") == first, "first").otherwise("second").alias("found"))


def area_edges(edges: DataFrame, areas: DataFrame, *by: str) -> DataFrame:
    """(by, area, internal, external): edges inside an area and edges that leave it, of the areas that have edges."""
    x, y = areas.select(F.col("node").alias("src"), F.col("area").alias("x")), areas.select(F.col("node").alias("dst"), F.col("area").alias("y"))
    ends = edges.join(F.broadcast(x), "src").join(F.broadcast(y), "dst")
    sides = ends.select(*by, (F.col("x") == F.col("y")).alias("inside"), F.explode(F.array_distinct(F.array("x", "y"))).alias("area"))
    return sides.groupBy(*by, "area").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))


def scaled(table: DataFrame, values: list[str], *by: str) -> DataFrame:
    """``values`` brought to 0..1 within each group; 0 where a group has one value only."""
    group = Window.partitionBy(*by)
    return table.select(*by, "node", *[F.coalesce(F.try_divide(F.col(v) - F.min(v).over(group), F.max(v).over(group) - F.min(v).over(group)), F.lit(0.0)).alias(v) for v in values])


def rank_agreement(table: DataFrame, x: str, y: str, *by: str, least: int = 6) -> DataFrame:
    """(by, n, rho): Spearman correlation of two columns; groups of fewer than ``least`` rows are left out."""
    ranked = table.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(x, *by).alias("rx"), average_rank(y, *by).alias("ry"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr("rx", "ry").alias("rho")).where(F.col("n") >= least)


def conservation_pairs(binary: DataFrame, weighted: DataFrame) -> DataFrame:
    """(method, g1, g2, jaccard, weighted_jaccard, difference): both similarities of each pair of groups."""
    key = ["method", "g1", "g2"]
    joined = binary.select(*key, "jaccard").join(weighted.select(*key, "weighted_jaccard"), key)
    return joined.withColumn("difference", F.col("weighted_jaccard") - F.col("jaccard"))


def conservation_summary(pairs: DataFrame) -> DataFrame:
    """(method, means, standard deviations, Pearson correlation, mean difference)."""
    both = [f(c).alias(f"{name}_{c}") for c in ("jaccard", "weighted_jaccard") for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return pairs.groupBy("method").agg(*both, safe_corr("jaccard", "weighted_jaccard").alias("correlation"), F.avg("difference").alias("mean_difference"))


def minus_log_p(tests: DataFrame, p: str) -> DataFrame:
    """(node, minus_log10): of p = 0, 1.2 times the largest finite one."""
    logs = tests.select("node", F.when(F.col(p) > 0, -F.log10(p)).alias("finite"))
    largest = logs.agg(F.max("finite").alias("largest"))  # one row
    return logs.join(F.broadcast(largest), F.lit(True)).select("node", F.coalesce("finite", 1.2 * F.col("largest")).alias("minus_log10"))


def pairwise_regressions(scores: DataFrame, *by: str) -> DataFrame:
    """(by, first, second, slope, intercept, r): the second approach's values on the first one's, for each two approaches."""
    a = scores.select(*by, "node", F.col("approach").alias("first"), F.col("value").alias("x"))
    b = scores.select(*by, "node", F.col("approach").alias("second"), F.col("value").alias("y"))
    return regression(a.join(b, [*by, "node"]).where("first < second"), "x", "y", *by, "first", "second")
