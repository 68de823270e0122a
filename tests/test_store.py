import pathlib

import pytest
from pyspark.sql import functions as F

from arborlens.runtime import new_path
from arborlens.sources.changes import changed_paths, diff_hunks, modified_paths
from arborlens.sources.store import GraphStore
from arborlens.sources.tree import current_head, project_root, scan_tree
from arborlens.streaming.maintain import apply_changes, dependents, ensure_fresh, freshness, full_index, watch

A = "from b import g\n\ndef f():\n    return g()\n"
B = "def g():\n    return 1\n"
CHANGE = "path string, content binary, op string, at bigint"


def tree(spark, **files):
    return spark.createDataFrame([(p.replace("_py", ".py"), bytearray(t.encode())) for p, t in files.items()], "path string, content binary")


def change(spark, *rows):
    return spark.createDataFrame([(p, None if t is None else bytearray(t.encode()), op, at) for p, t, op, at in rows], CHANGE)


def names(store):
    return {r.qualified_name for r in store.read("symbols").collect()}


def test_index_and_changes(spark):
    store = GraphStore(spark, new_path(spark, "store"))
    assert store.read("files").count() == 0
    files = tree(spark, a_py=A, b_py=B)
    full_index(store, files)
    assert names(store) == {"a.py::f", "b.py::g"}
    assert ("imports_from", "a.py", "b.py") in {(r.kind, r.source, r.target) for r in store.read("edges").collect()}
    assert apply_changes(store, change(spark, ("b.py", B, "modify", 1)), files, 0) is False
    assert apply_changes(store, change(spark, ("b.py", "x", "modify", 1), ("b.py", B + "\ndef h(): pass\n", "modify", 2), ("target/c.py", "y = 1", "add", 3)), files, 1)
    assert names(store) == {"a.py::f", "b.py::g", "b.py::h"}
    assert apply_changes(store, change(spark, ("b.py", "z = 1", "modify", 9)), files, 1) is False
    assert apply_changes(store, change(spark, ("b.py", None, "delete", 3)), files, 2)
    assert names(store) == {"a.py::f"} and {r.path for r in store.read("files").collect()} == {"a.py"}
    assert not [r for r in store.read("edges").collect() if "b.py" in (r.source, r.target)]


def test_stream(spark, tmp_path):
    store = GraphStore(spark, new_path(spark, "store"))
    files = tree(spark, a_py=A, b_py=B)
    log = str(tmp_path / "log")
    change(spark, ("a.py", A, "add", 1), ("b.py", B, "add", 1)).write.parquet(log)
    for extra in (None, change(spark, ("b.py", "def k(): pass\n", "modify", 2))):
        if extra is not None:
            extra.write.mode("append").parquet(log)
        watch(spark.readStream.schema(CHANGE).parquet(log), store, files, str(tmp_path / "cp"), once=True).awaitTermination()
    assert names(store) == {"a.py::f", "b.py::k"}


def test_dependents(spark):
    symbols = spark.createDataFrame([("a::f", "a"), ("b::g", "b"), ("c::h", "c"), ("n::n", None)], "qualified_name string, file_path string")
    edges = spark.createDataFrame([("calls", "a::f", "b::g"), ("calls", "n::n", "b::g"), ("imports_from", "c", "b"), ("calls", "b::g", "b::g")], "kind string, source string, target string")
    changed = spark.createDataFrame([("b",)], "path string")
    assert {r.path for r in dependents(symbols, edges, changed).collect()} == {"a"}
    assert {r.path for r in dependents(symbols, edges, changed, True).collect()} == {"a", "c"}


def test_embeddings_and_schema(spark):
    store = GraphStore(spark, new_path(spark, "store"))
    rows = spark.createDataFrame([("q", [1.0], "h", "p", "2024"), ("q", [2.0], "i", "p", "2025"), ("r", [3.0], "j", "p", "2025")], "qualified_name string, vector array<float>, text_hash string, provider string, created_at string")
    store.store_embeddings(rows)
    assert {(r.qualified_name, r.text_hash) for r in store.read("embeddings").collect()} == {("q", "i"), ("r", "j")}
    store.remove_embeddings(rows.where("qualified_name = 'q'"))
    assert store.read("embeddings").count() == 1
    assert store.has_embedding("r") and not store.has_embedding("q") and store.embedding_count() == 1
    assert [tuple(r) for r in store.embedding_hashes().collect()] == [("r", "j")]
    number, now = store.log.newest()
    store.log.publish(number + 1, now | {"schema": 99})
    with pytest.raises(ValueError):
        GraphStore(spark, store.root)


def folder_bytes(root):
    return sum(f.stat().st_size for f in pathlib.Path(root.removeprefix("file:")).rglob("*.parquet"))


def test_a_small_batch_writes_little(spark):
    store = GraphStore(spark, new_path(spark, "store"), max_segments=2)
    files = {f"m{i:03}_py": "".join(f"def f{i}_{k}():\n    return {k}\n\n" for k in range(40)) for i in range(20)} | {"a_py": A, "b_py": B}
    content = tree(spark, **files)
    full_index(store, content)
    before = folder_bytes(store.root)
    assert apply_changes(store, change(spark, ("b.py", B + "# new\n", "modify", 1)), content, 1)
    assert folder_bytes(store.root) - before < before / 3
    assert len(names(store)) == 20 * 40 + 2 and store.read("files").count() == 22
    for batch in range(2, 4):
        apply_changes(store, change(spark, ("b.py", B + f"# {batch}\n", "modify", batch)), content, batch)
    assert len(names(store)) == 20 * 40 + 2 and store.vacuum() > 0
    assert all(len(s) <= 2 for s in store._now()[1]["tables"].values())
    assert len(names(store)) == 20 * 40 + 2 and ("contains", "b.py", "b.py::g") in {(r.kind, r.source, r.target) for r in store.read("edges").collect()}


def test_a_store_of_the_schema_before_is_upgraded(spark):
    store = GraphStore(spark, new_path(spark, "store"))
    full_index(store, tree(spark, a_py=A, b_py=B))
    number, now = store.log.newest()
    store.log.publish(number + 1, {"schema": 2, "tables": {name: segments[0][0] for name, segments in now["tables"].items()}, "batch": 7})
    again = GraphStore(spark, store.root)
    assert names(again) == {"a.py::f", "b.py::g"} and again.last_batch() == 7
    again.remove_files(spark.createDataFrame([("a.py",)], "path string"))
    assert names(again) == {"b.py::g"} and again.log.newest()[1]["schema"] == 3


def test_fresh_before_a_query(spark):
    store = GraphStore(spark, new_path(spark, "store"))
    with_hash = lambda **f: tree(spark, **f).withColumn("hash", F.sha2("content", 256))
    full_index(store, with_hash(a_py=A, b_py=B))
    assert ensure_fresh(store, with_hash(a_py=A, b_py=B)) is False
    later = with_hash(a_py=A, c_py="def k(): pass\n")
    assert {tuple(r) for r in freshness(store.read("files"), later).collect()} == {("b.py", "removed"), ("c.py", "new")}
    assert ensure_fresh(store, later) is True and names(store) == {"a.py::f", "c.py::k"}
    assert ensure_fresh(store, later) is False


def test_root_and_head(tmp_path):
    (tmp_path / "p/.git/refs/heads").mkdir(parents=True)
    (tmp_path / "p/src").mkdir()
    root = project_root(str(tmp_path / "p/src"))
    assert root == str((tmp_path / "p").resolve()) and current_head(str(tmp_path)) is None
    (tmp_path / "p/.git/HEAD").write_text("ref: refs/heads/main\n")
    assert current_head(root) is None
    (tmp_path / "p/.git/packed-refs").write_text("# pack\nabc refs/heads/main\n")
    assert current_head(root) == "abc"
    (tmp_path / "p/.git/refs/heads/main").write_text("def\n")
    assert current_head(root) == "def"
    (tmp_path / "p/.git/HEAD").write_text("123\n")
    assert current_head(root) == "123"


DIFF = """diff --git a/old.py b/new.py
similarity index 90%
rename from old.py
rename to new name.py
@@ -1,2 +3,4 @@ def f
+x
@@ -9 +8,0 @@
diff --git a/z.go b/z.go
@@ -5,0 +6 @@
"""


def test_diffs_and_status(spark):
    frame = spark.createDataFrame([(1, DIFF), (2, None), (3, "")], "diff_id int, text string")
    got = [tuple(r)[1:] for r in diff_hunks(frame).collect()]
    assert sorted(got) == sorted([("new name.py", 1, 2, 3, 4), ("new name.py", 9, 1, 8, 0), ("z.go", 5, 0, 6, 1)])
    for bad in ("diff --git a/x b/x\n@@ -1 1 @@", "@@ -1 +1 @@"):
        with pytest.raises(Exception, match="hunk header"):
            diff_hunks(spark.createDataFrame([(1, bad)], "diff_id int, text string")).collect()
    status = spark.createDataFrame([(1, " M a.py\nR  b.go -> c/d.go\n?? x.md\nA\n")], "list_id int, text string")
    assert {r.path for r in modified_paths(status).collect()} == {"a.py", "c/d.go"}
    assert {r.path for r in changed_paths(spark.createDataFrame([(1, "a\n\nb\n")], "list_id int, text string")).collect()} == {"a", "b"}


def test_tree(spark, tmp_path):
    for path in ("a.py", "src/b.ts", "src/gen/c.ts", "node_modules/d.js", "notes.md", "src/keep.gen.ts", "build/e.go"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    found = scan_tree(spark, str(tmp_path), ["# comment", "gen/", "*.gen.ts", "!keep.gen.ts", "/build"])
    rows = {r.path: (r.language, r.hash) for r in found.select("path", "language", "hash").collect()}
    assert set(rows) == {"a.py", "src/b.ts", "src/keep.gen.ts"} and rows["src/b.ts"][0] == "TypeScript" and len(rows["a.py"][1]) == 64
    assert found.select(F.decode("content", "UTF-8")).first()[0] == "x = 1\n"
