"""Parquet and JSON storage of graphs, partitions, address maps and results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from kithwatch.graph import Graph


def save_graph(graph: Graph, path: str, mode: str = "errorifexists") -> None:
    graph.nodes.write.mode(mode).parquet(f"{path}/nodes")
    graph.edges.write.mode(mode).parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def save_address_users(address_user: DataFrame, path: str, mode: str = "errorifexists") -> None:
    address_user.write.mode(mode).parquet(path)


def load_address_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str, delete: bool = False) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.delete(target, True) if delete else system.exists(target)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to its end; half a result lacks the mark."""
    return _exists(spark, f"{path}/_SUCCESS")


def _load_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        found = spark.read.parquet(path)
        return found if written(spark, path) else None
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cached_communities(
    spark: SparkSession, path: str | None, method: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    """Communities stored for the method, computed and stored first where there are none.

    ``path`` belongs to one graph; each method has a folder of its own below it.
    """
    if path is None:
        return compute()
    found = _load_if_there(spark, f"{path}/{method}")
    return found if found is not None else store_communities(compute(), path, method)


def store_communities(communities: DataFrame, path: str | None, method: str) -> DataFrame:
    """Replace the communities stored for a method."""
    if not path:
        raise ValueError("no path to store communities at")
    communities.write.mode("overwrite").parquet(f"{path}/{method}")
    return communities.sparkSession.read.parquet(f"{path}/{method}")


def save_anomalies(anomalies: DataFrame, path: str, mode: str = "overwrite") -> None:
    anomalies.write.mode(mode).parquet(f"{path}/anomalies")


def save_anomalies_json(anomalies: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per anomaly; an infinite score is the text ``Infinity``.

    Raises when there is no anomaly to write. What was written is looked at, so the plan runs
    once.
    """
    anomalies.write.mode(mode).json(path)
    if mode != "append" and anomalies.sparkSession.read.text(path).isEmpty():
        _exists(anomalies.sparkSession, path, delete=True)
        raise ValueError("no anomalies to write")
