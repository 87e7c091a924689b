"""Communities, feature selection and glance scores of a graph file, as one job.

    spark-submit jobs/detect.py GRAPHML OUTPUT [CACHE]

OUTPUT gets the anomalies as JSON; CACHE keeps the communities for the next run.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from kithwatch import detect_anomalies  # noqa: E402
from kithwatch.shipping import ship  # noqa: E402
from kithwatch.sources.graphml import read_graphml  # noqa: E402


def main(graphml: str, output: str, cache: str | None = None) -> None:
    begun = time.perf_counter()
    spark = SparkSession.builder.appName("detect").getOrCreate()
    ship(spark)
    found = detect_anomalies(
        read_graphml(spark, graphml),
        comm_method="louvain",
        anomaly_method="glance",
        feature_selection="laplacian",
        community_cache_path=cache,
    )
    with found:
        found.save_json(output)
        print(f"selected {found.selected}, {time.perf_counter() - begun:.1f} s")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
