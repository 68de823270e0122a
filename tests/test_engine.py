import json

import pytest
from pyspark.sql import functions as F

from arborlens.config import load_config
from arborlens.engine import Engine, compact_lines, json_lines, source_files, target_kind
from arborlens.model import EngineConfig
from arborlens.operators.search import hash_embedder
from arborlens.runtime import new_path, numbered
from arborlens.sources.store import GraphStore
from arborlens.operators.search import phrase_search, phrase_search_all
from arborlens.sources.suites import read_manifest, read_queries, read_scenarios
from arborlens.streaming.maintain import full_index

SOURCES = {
    "app/main.py": "from .util import helper\n\ndef main():\n    x = helper(1)\n    y = x + 2\n    return y\n",
    "app/util.py": "class Store:\n    def get(self, k):\n        a = k\n        b = a\n        return b\n\ndef helper(v):\n    return v\n",
    "app/copy.py": "class Store:\n    def get(self, k):\n        a = k\n        b = a\n        return b\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    store = GraphStore(spark, new_path(spark, "store"))
    full_index(store, spark.createDataFrame([(p, bytearray(t.encode())) for p, t in SOURCES.items()], "path string, content binary"))
    own = Engine.of_store(store)
    calls = spark.createDataFrame([(900, "calls", "app/main.py::main", "app/util.py::helper", None), (901, "calls", "app/util.py::helper", "app/util.py::Store.get", None)], own.edges.schema)
    return Engine(own.files, own.symbols, own.edges.unionByName(calls))


def test_commands(engine, spark):
    assert {r.qualified_name for r in engine.find("helper").collect()} == {"app/util.py::helper"}
    assert {r.source for r in engine.callers("app/util.py::helper").collect()} == {"app/main.py::main"}
    assert {r.target for r in engine.callees("app/main.py::main").collect()} == {"app/util.py::helper"}
    assert engine.refs("app/util.py").count() == 1
    assert [(r.node, r.depth) for r in engine.impact("app/main.py::main", confidence="high").collect()] == [("app/util.py::helper", 1), ("app/util.py::Store.get", 2)]
    assert engine.impact("app/main.py", confidence="high").count() == 0
    assert engine.impact("app/main.py", confidence="high", with_symbols=True).count() == 2
    assert {r.node for r in engine.impact("app/util.py::helper", confidence="high", direction="backward").collect()} == {"app/main.py::main"}
    assert {r.target for r in engine.diff("diff --git a/app/main.py b/app/main.py\n@@ -4 +4 @@\n", confidence="high").collect()} == {"app/main.py::main"}
    assert [r.qualified_name for r in engine.entry_points().where("entry_kind = 'main'").collect()] == ["app/main.py::main"]
    assert ["app/main.py::main", "app/util.py::helper", "app/util.py::Store.get"] in [r.path for r in engine.flows().collect()]
    assert engine.flows("app/util.py::Store.get").count() >= 1
    assert engine.criticality().first().qualified_name == "app/util.py::helper"
    assert engine.risk(("main",), ("auth",)).first().sensitivity == 1.0
    texts = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    assert {r.qualified_name for r in engine.clones(texts).where("representative = 'app/copy.py::Store'").collect()} == {"app/copy.py::Store", "app/util.py::Store"}
    assert engine.community_of("app/main.py::main").count() == engine.communities().count()
    assert engine.search("helper").first().qualified_name == "app/util.py::helper"
    assert [r.qualified_name for r in engine.dead_code().collect()] == ["app/copy.py::Store.get"]
    assert {r.table_name: r.n for r in engine.stats().collect()}["files"] == 3
    assert json.loads(json_lines(engine.find("helper")).first()[0])["qualified_name"] == "app/util.py::helper"
    assert compact_lines(spark.createDataFrame([(1, ["a", "b"], None)], "x int, y array<string>, z string")).first()[0] == "1\ta,b\t"
    assert source_files(spark.createDataFrame([("a.py",), ("b.md",)], "path string")).count() == 1


def test_card_and_embedding(engine, spark):
    texts = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    card = {r.measure: r.value for r in engine.stats_card(texts).collect()}
    assert card["symbols"] == 6 and card["n_clusters"] == 1 and card["n_flows"] >= 1
    assert {r.measure for r in engine.stats_card(central_limit=1).collect()} == {"symbols"}
    store = GraphStore(spark, new_path(spark, "vectors"))
    store.store_embeddings(spark.createDataFrame([("gone", [1.0], "h", "p", "2020")], store.read("embeddings").schema))
    assert engine.embed(store, hash_embedder(8), "hash") == (6, 1)
    assert engine.embed(store, hash_embedder(8), "hash") == (0, 0)
    assert {len(r.vector) for r in store.read("embeddings").collect()} == {8} and store.read("embeddings").count() == 6


def test_suites(engine, spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"suite": {"name": "s", "description": ""}, "repos": [{"name": "r", "url": "u", "revision": "1", "languages": ["python"]}]}))
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"repo": "r", "query": "helper", "expected": ["app/util.py::helper"]}, {"repo": "r", "query": "nothing", "expected": ["x"], "category": "c"}]}))
    (tmp_path / "i.json").write_text(json.dumps({"scenarios": [{"repo": "r", "description": "", "target": "app/main.py::main", "depth": 1, "confidence": "high", "expected_affected": ["app/util.py::helper", "z"]}]}))
    assert read_manifest(spark, str(tmp_path / "m.json")).first().languages == ["python"]
    queries = read_queries(spark, str(tmp_path / "q.json"))
    assert {r.category: r.mean_reciprocal_rank for r in engine.search_suite(queries).collect()} == {"uncategorized": 1.0, "c": 0.0}
    found = engine.impact_suite(read_scenarios(spark, str(tmp_path / "i.json"))).first()
    assert (found.precision, found.recall) == (1.0, 0.5)


def test_many_queries_as_one(engine):
    texts = ["helper", "app util", "sto", "get", "nothing at all", "", "py st"]
    found = phrase_search_all(engine.symbols, list(enumerate(texts))).collect()
    for i, text in enumerate(texts):
        alone = {(r.qualified_name, r.score) for r in phrase_search(engine.symbols, text).collect()}
        assert {(r.qualified_name, r.score) for r in found if r.query_id == i} == alone
    assert phrase_search_all(engine.symbols, []).count() == 0


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    assert load_config(str(path)) == EngineConfig()
    path.write_text("[flows]\nmax-depth = 5\n[risk]\ncriticality = 1\npatterns = ['x']\n[other]\na = 1\n[watch]\nb = 2\n")
    config = load_config(str(path))
    assert config.flows.max_depth == 5 and config.risk.patterns == ("x",) and config.risk.criticality == 1.0
    for bad in ("[flows]\nmax_depth = 'x'\n", "[flows\n", "flows = 3\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            load_config(str(path))


def test_targets():
    assert [target_kind(t) for t in ("a::b", "src/a", "a.py", "name", "v1.2")] == ["symbol", "file", "file", "symbol", "symbol"]


def test_numbered(spark):
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), "id").repartition(7)
    rows = numbered(frame, [F.desc("k")], "n").collect()
    assert all(r.n == 1000 - r.k for r in rows) and len(rows) == 1000
    assert numbered(frame.where("false"), ["k"], "n").count() == 0
