"""Named datasets below a root folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kithwatch.graph import Graph
from kithwatch.sources.graphml import read_graphml
from kithwatch.sources.store import load_graph, save_graph

# Dataset names and the format each is kept in.
DATASETS = {
    "disney_amazon": "graphml",
    "us_election_retweets": "parquet",
    "bitcoin_2012": "parquet",
    "bitcoin_2013": "parquet",
    "bitcoin_2012_reduced": "parquet",
}


class Datasets:
    """Loads and saves graphs by name from ``<root>/<name>``, unless told another place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._places = {name: (form, f"{root}/{name}") for name, form in DATASETS.items()}

    def register(self, name: str, form: str, path: str) -> None:
        """Add or move a dataset; ``form`` is ``graphml`` or ``parquet``."""
        if form not in ("graphml", "parquet"):
            raise ValueError(f"unknown format {form!r}")
        self._places[name] = (form, path)

    def load(self, name: str) -> Graph:
        form, path = self._place(name)
        return read_graphml(self.spark, path) if form == "graphml" else load_graph(self.spark, path)

    def save(self, name: str, path: str) -> None:
        """Write a copy of a dataset as Parquet."""
        save_graph(self.load(name), path)

    def _place(self, name: str) -> tuple[str, str]:
        if name not in self._places:
            raise ValueError(f"unknown dataset {name!r}, expected one of {sorted(self._places)}")
        return self._places[name]
