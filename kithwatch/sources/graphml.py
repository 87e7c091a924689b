"""GraphML files as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithwatch.functions.expressions import high_end, low_end
from kithwatch.graph import Graph

# Attribute types of the format and the column types that hold them.
COLUMN_TYPES = {
    "boolean": "boolean",
    "int": "bigint",
    "long": "bigint",
    "float": "double",
    "double": "double",
    "string": "string",
}

_DATA = "data array<struct<_VALUE string, _key string>>"
_KEY = "_id string, `_attr.name` string, `_attr.type` string, _for string, default string"


def read_graphml(spark: SparkSession, path: str, name_by: str = "name", directed: str = "error") -> Graph:
    """Read an undirected graph from a file, a folder or a pattern.

    Attributes become columns of their declared type, named by ``attr.name`` or, with
    ``name_by="id"``, by the key that the data refer to. Declared defaults fill missing
    values. Ends of edges that are not declared become nodes with default attributes. Of
    several edges between two nodes one stays, that with the smallest attributes. A graph that
    says its edges are directed raises, unless ``directed="ignore"`` takes them as undirected.
    """
    if directed not in ("error", "ignore"):
        raise ValueError(f"directed must be 'error' or 'ignore', not {directed!r}")
    if name_by not in ("name", "id"):
        raise ValueError(f"name_by must be 'name' or 'id', not {name_by!r}")

    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    # The declarations are as few as the attributes of the schema.
    keys = sorted(rows("key", _KEY).distinct().collect(), key=lambda key: key["_id"])

    def attributes(of: str):
        values = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], F.coalesce(d["_VALUE"], F.lit("")))))
        values = F.coalesce(values, F.create_map().cast("map<string,string>"))
        for key in keys:
            if key["_for"] not in (of, "all"):
                continue
            kind = COLUMN_TYPES.get(key["_attr.type"] or "string", "string")
            text = F.coalesce(F.try_element_at(values, F.lit(key["_id"])), F.lit(key["default"]))
            name = (key["_attr.name"] if name_by == "name" else None) or key["_id"]
            yield (text if kind == "string" else F.trim(text).try_cast(kind)).alias(name)

    # One row for each graph element that says so.
    if directed == "error" and not rows("graph", "_edgedefault string").where("_edgedefault = 'directed'").isEmpty():
        raise ValueError("the edges are directed; directed='ignore' reads them as undirected")
    linked = rows("edge", f"_source string, _target string, {_DATA}")
    declared = rows("node", f"_id string, {_DATA}")
    ends = linked.select(F.explode(F.array("_source", "_target")).alias("_id")).distinct()
    missing = ends.join(declared, "_id", "left_anti").withColumn("data", F.lit(None).cast(declared.schema["data"].dataType))
    nodes = declared.unionByName(missing).select(F.col("_id").alias("id"), *attributes("node"))
    edges = linked.select(
        low_end("_source", "_target").alias("src"), high_end("_source", "_target").alias("dst"), *attributes("edge")
    )
    extra = [name for name in edges.columns if name not in ("src", "dst")]
    if not extra:
        return Graph(nodes, edges.distinct())
    one = edges.groupBy("src", "dst").agg(F.min(F.struct(*(F.col(f"`{name}`") for name in extra))).alias("kept"))
    return Graph(nodes, one.select("src", "dst", "kept.*"))
