import glob

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kithwatch import Graph
from kithwatch.operators.scratch import Scratch, clear_scratch, scratch_root
from kithwatch.sources.datasets import Datasets
from kithwatch.sources.graphml import read_graphml
from kithwatch.sources.store import load_graph, save_graph

DOCUMENT = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="node" attr.name="Class Name" attr.type="int"/><key id="d1" for="node" attr.name="price" attr.type="double"><default>2.5</default></key>
<key id="d2" for="node" attr.name="label" attr.type="string"/>
<key id="d3" for="node" attr.name="open" attr.type="boolean"/>
<key id="d4" for="edge" attr.name="weight" attr.type="float"/>
<graph edgedefault="undirected">
<node id="b"><data key="d0"> 7 </data><data key="d2">05</data><data key="d3">true</data></node><node id="a"/>
<node id="c"><data key="d1">1e3</data><data key="d0">x</data></node>
<edge source="b" target="a"><data key="d4">1.5</data></edge><edge source="b" target="c"/>
</graph>
</graphml>
"""


def test_graphml(spark, tmp_path):
    path = tmp_path / "graph.graphml"
    path.write_text(DOCUMENT)
    found = read_graphml(spark, str(path))
    assert [(f.name, f.dataType.simpleString()) for f in found.nodes.schema] == [
        ("id", "string"),
        ("Class Name", "bigint"),
        ("price", "double"),
        ("label", "string"),
        ("open", "boolean"),
    ]
    assert {r["id"]: tuple(r)[1:] for r in found.nodes.collect()} == {
        "a": (None, 2.5, None, None),
        "b": (7, 2.5, "05", True),
        "c": (None, 1000.0, None, None),
    }
    assert {tuple(r) for r in found.edges.collect()} == {("a", "b", 1.5), ("b", "c", None)}
    assert "d0" in read_graphml(spark, str(path), name_by="id").nodes.columns
    with pytest.raises(ValueError):
        read_graphml(spark, str(path), name_by="label")


def test_stored_graph(spark, tmp_path):
    graph = Graph(
        spark.createDataFrame([(1, [0.5])], "id long, v array<double>"),
        spark.createDataFrame([(1, 1)], "src long, dst long"),
    )
    save_graph(graph, str(tmp_path / "g"))
    found = load_graph(spark, str(tmp_path / "g"))
    assert rows(found.nodes) == [(1, [0.5])] and rows(found.edges) == [(1, 1)]


def test_datasets(spark, tmp_path):
    (tmp_path / "disney_amazon").write_text(DOCUMENT)
    data = Datasets(spark, str(tmp_path))
    assert data.load("disney_amazon").nodes.count() == 3
    data.save("disney_amazon", str(tmp_path / "copy"))
    data.register("mine", "parquet", str(tmp_path / "copy"))
    assert data.load("mine").edges.count() == 2
    with pytest.raises(ValueError):
        data.load("unknown")
    with pytest.raises(ValueError):
        data.register("mine", "csv", "/nowhere")


def test_scratch(spark):
    scratch = Scratch(spark, "test")
    assert scratch.base.startswith(scratch_root(spark))
    table = scratch.save(spark.range(3).withColumn("empty", F.lit(None).cast("string")), "numbers")
    assert rows(table.where("id > 0"), "id") == [(1,), (2,)]
    assert scratch.save(table.where("false"), "none").count() == 0
    scratch.drop("numbers")
    assert not glob.glob(f"{scratch.base}/numbers")
    assert callable(clear_scratch)
