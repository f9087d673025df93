"""aggregated_metrics() computes the metrics of the swept networks once, with the same rates."""

from pyspark.sql import functions as F

from hubweave.operators import persistence


def test_networks_metrics_are_read_once(spark):
    swept = spark.createDataFrame([("m", "g", k, 0.1 * k, n, float(k + 1)) for k in range(3) for n in "ab" if (k, n) != (2, "b")], "method string, grp string, step int, threshold double, node string, strength double")
    metrics = spark.range(7, 10).select(F.lit("m").alias("method"), F.lit("g").alias("grp"), (F.col("id") - 7).cast("int").alias("step"), (F.lit(0.1) * (F.col("id") - 7)).alias("threshold"), F.lit(0.5).alias("clustering"), F.lit(0.4).alias("density"))
    out = persistence.aggregated_metrics(swept, metrics)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (7, 10") == 1
    got = {r["node"]: (round(r["mean_strength"], 9), round(r["stability"], 9), round(r["appearance_rate"], 9)) for r in out.collect()}
    assert got == {"a": (2.0, 0.2, 1.0), "b": (1.5, 0.2, round(2 / 3, 9))}
