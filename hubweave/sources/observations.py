"""Observation tables: subjects x numeric regions with a group label.

Wide input becomes (grp, subject, values): one array per subject in a fixed order of nodes. Pairs of nodes are then
formed inside a row, so correlations need no self-join and aggregate before the only shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column names that are never regions (fixed values; matched without regard to case).
NOT_REGIONS = ("^Group$", "^Subject", "^ID", "^Age", "^Sex", "^Treatment", "^Weight", "^Behavior", "^Loco")


def read_observations(spark: SparkSession, path: str, file_format: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A wide observation table from Parquet, or CSV with a header row."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if file_format == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.format(file_format).load(path)


def region_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose name is not on the list above."""
    barred = re.compile("|".join(NOT_REGIONS), re.IGNORECASE)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and not barred.search(f.name)]


def subject_values(df: DataFrame, group_name: str, columns: list[str] | None = None) -> DataFrame:
    """The region columns of one group; ValueError without a Group column."""
    if "Group" not in df.columns:
        raise ValueError("observations need a Group column")
    return df.where(F.col("Group") == group_name).select(*(columns or region_columns(df)))


def vectors(df: DataFrame, nodes: list[str], group: str = "Group", subject: str = "Subject") -> DataFrame:
    """(grp, subject, values) from a wide table; values follow ``nodes``."""
    return df.select(F.col(group).cast("string").alias("grp"), F.col(subject).cast("long").alias("subject"), F.array(*[F.col(c).cast("double") for c in nodes]).alias("values"))


def to_long(rows: DataFrame, nodes: list[str]) -> DataFrame:
    """(grp, subject, node, value) from vectors."""
    names = F.array(*[F.lit(n) for n in nodes])
    return rows.select("grp", "subject", F.posexplode("values").alias("pos", "value")).select("grp", "subject", F.get(names, F.col("pos")).alias("node"), "value")


def to_vectors(long: DataFrame, nodes: list[str]) -> DataFrame:
    """(grp, subject, values) from (grp, subject, node, value); absent values are null."""
    found = long.groupBy("grp", "subject").agg(F.map_from_entries(F.collect_list(F.struct("node", "value"))).alias("m"))
    return found.select("grp", "subject", F.array(*[F.try_element_at("m", F.lit(n)) for n in nodes]).alias("values"))


def embedding_vectors(spark: SparkSession, sf_dir: str, dims: int = 12) -> tuple[DataFrame, list[str]]:
    """The driver's ``embeddings`` table as observations: label = group, dimension = node."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.select(F.concat(F.lit("g"), F.col("label").cast("string")).alias("grp"), F.col("vec_id").cast("long").alias("subject"), F.transform(F.slice("embedding", 1, dims), lambda x: x.cast("double")).alias("values"))
    return rows, [f"d{i:02d}" for i in range(dims)]


def areas_of(spark: SparkSession, areas: dict[str, list[str]]) -> DataFrame:
    """(area, area_ord, node) from an ordered mapping of areas to nodes."""
    return spark.createDataFrame([(a, k, n) for k, (a, nodes) in enumerate(areas.items()) for n in nodes], "area string, area_ord int, node string")
