import hashlib
import random
from collections import Counter, defaultdict

import pytest

from arborlens.operators.hierarchy import descendants, hierarchy, parent_links
from arborlens.operators.incremental import KeyedState, digest, epoch_seconds, replay_runs
from arborlens.operators.orphans import count_keys, orphan_keys, orphan_rows
from arborlens.operators.skew import balanced_join, balanced_stats, plan_load
from arborlens.runtime import new_path
from arborlens.sources.versions import VersionConflict, VersionLog
from pyspark.sql import functions as F

FEED = "table_name string, record_key string, stamp bigint, content_hash binary, load_id bigint"


def feed(spark, rows):
    return spark.createDataFrame([("t", k, s, None if h is None else bytearray(h.encode()), load) for k, s, h, load in rows], FEED)


def state(spark, **more):
    return KeyedState(spark, new_path(spark, "state"), **more)


def changes(frame):
    return sorted((r.record_key, r.change) for r in frame.collect())


# --- 1 --------------------------------------------------------------------------


def test_new_changed_touched_late_and_repeated(spark):
    s = state(spark)
    rows = feed(spark, [("a", 1, "x", 1), ("a", 1, "x", 1), ("b", 5, "y", 1), (None, 1, "x", 1), ("c", None, "x", 1), ("n", 1, None, 1)])
    assert changes(s.apply(1, rows)) == [("a", "new"), ("b", "new"), ("n", "new")]
    assert changes(s.apply(2, feed(spark, [("a", 2, "x", 2), ("b", 4, "z", 2), ("n", 2, "h", 2)]))) == [("n", "changed")]
    assert changes(s.apply(3, feed(spark, [("a", 3, "w", 3), ("a", 2, "q", 3)]))) == [("a", "changed")]
    assert changes(s.apply(3, feed(spark, [("z", 9, "w", 3)]))) == [("a", "changed")]
    assert changes(s.apply(4, feed(spark, []))) == []
    assert {(r.record_key, r.stamp) for r in s.current().collect()} == {("a", 3), ("b", 5), ("n", 2)}


def test_a_run_that_dies_before_the_commit_is_repeated_in_full(spark):
    s = state(spark)
    s.apply(1, feed(spark, [("a", 1, "x", 1)]))
    publish, s.log.publish = s.log.publish, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        s.apply(2, feed(spark, [("a", 2, "y", 2), ("b", 1, "z", 2)]))
    s.log.publish = publish
    again = KeyedState(spark, s.root)
    assert changes(again.apply(2, feed(spark, [("a", 2, "y", 2), ("b", 1, "z", 2)]))) == [("a", "changed"), ("b", "new")]


def test_a_run_that_dies_after_the_commit_is_told_again(spark):
    s = state(spark)
    delivered = feed(spark, [("a", 1, "x", 1), ("b", 1, "z", 1)])
    s.apply(1, delivered)
    again = KeyedState(spark, s.root)
    assert changes(again.apply(1, delivered)) == [("a", "new"), ("b", "new")]
    for run in range(2, 8):
        again.apply(run, feed(spark, [("a", run, f"x{run}", run), ("b", run, "z", run)]))
    assert changes(KeyedState(spark, s.root).apply(1, delivered)) == [("a", "new"), ("b", "new")]
    again.acknowledge(1)
    again.acknowledge(1)
    assert changes(KeyedState(spark, s.root).apply(1, delivered)) == []
    assert again.vacuum() > 0
    assert changes(again.output(5)) == [("a", "changed")]
    assert {(r.record_key, r.stamp) for r in again.current().collect()} == {("a", 7), ("b", 7)}


def test_a_run_that_dies_while_segments_are_merged(spark):
    s = state(spark, buckets=3, max_segments=1)
    s.apply(1, feed(spark, [("a", 1, "x", 1), ("b", 1, "z", 1)]))
    newest, s._newest = s._newest, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    late = feed(spark, [("a", 2, "y", 2), ("c", 1, "z", 2)])
    with pytest.raises(OSError):
        s.apply(2, late)
    again = KeyedState(spark, s.root, max_segments=1)
    assert changes(again.apply(2, late)) == [("a", "changed"), ("c", "new")]
    assert again.manifest().buckets == 3 and len(again.manifest().segments) == 1
    assert again.vacuum() == 1


def test_state_is_not_shuffled(spark):
    s = state(spark)
    s.apply(1, feed(spark, [(f"k{i}", 1, "x", 1) for i in range(500)]))
    path, buckets = s.manifest().segments[0][0], s.manifest().buckets
    plan = s._segment(path, buckets).groupBy("table_name", "record_key").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_file_systems_without_atomic_rename_are_refused(spark):
    with pytest.raises(ValueError):
        VersionLog(spark, new_path(spark, "log"), schemes=["hdfs"])


def test_only_one_of_two_writers_commits(spark):
    s = state(spark)
    s.apply(1, feed(spark, [("a", 1, "x", 1)]))
    with pytest.raises(VersionConflict):
        s.log.publish(1, {})


def test_replay_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdef"), rng.randint(1, 40), rng.choice("xyz"), rng.randint(1, 12)) for _ in range(150)]
    unique = {(k, s): (k, s, h, load) for k, s, h, load in reversed(rows)}
    rows = list(unique.values())
    runs = [(i, i not in (3, 4, 7, 12)) for i in range(1, 13)]
    got = {(run, r.record_key) for run, f in replay_runs(state(spark, buckets=5, max_segments=2), runs, feed(spark, rows), new_path(spark, "d")) for r in f.collect()}
    wanted, before = set(), {}
    for run, ok in runs:
        if ok:
            now = {}
            for k, s, h, load in rows:
                if load <= run and (k not in now or s > now[k][0]):
                    now[k] = (s, h)
            wanted |= {(run, k) for k, (s, h) in now.items() if k not in before or before[k][1] != h}
            before = now
    assert got == wanted


def test_no_successful_run(spark):
    assert replay_runs(state(spark), [(1, False)], feed(spark, []), new_path(spark, "d")) == []


def test_spellings(spark):
    h = hashlib.sha256(b"x").hexdigest()
    rows = spark.createDataFrame([(h,), (f" {h.upper()}  ",), (f"SHA256:{h}",), (f"sha-256={h}",), (None,)], "h string").select(digest(F.col("h")))
    assert [r[0] for r in rows.collect()] == [h, h, h, h, None]
    stamps = spark.createDataFrame([(1738236456,), (1742305470184,), (None,)], "s bigint").select(epoch_seconds(F.col("s")))
    assert [r[0] for r in stamps.collect()] == [1738236456, 1742305470, None]


# --- 2 --------------------------------------------------------------------------


def brute_forest(parents):
    out = {}
    for node in parents:
        path, at = [node], node
        while at in parents and parents[at] not in path:
            at = parents[at]
            path.append(at)
        if at not in parents:
            out[node] = (at, len(path) - 1, list(reversed(path)))
        else:
            cycle = path[path.index(parents[at]) :]
            out[node] = (min(cycle), -1, None)
    return out


def check_forest(spark, parents):
    links = spark.createDataFrame([(n, p, "x") for n, p in parents.items()], "node string, parent string, dist string")
    got = {r.node: (r.root_node, r.depth, r.path) for r in hierarchy(links, with_paths=True).collect()}
    assert got == brute_forest(parents)
    return got


def test_chain_star_and_cycles(spark):
    parents = {f"c{i:03}": f"c{i + 1:03}" for i in range(90)}
    parents |= {f"s{i}": "hub" for i in range(40)} | {"hub": "top"}
    parents |= {"x": "y", "y": "z", "z": "x", "below": "y", "lower": "below", "self": "self", "under": "self", "p": "q", "q": "p"}
    check_forest(spark, parents)


def test_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        nodes = [f"n{i}" for i in range(60)]
        check_forest(spark, {n: rng.choice(nodes) for n in nodes if rng.random() < 0.95})


def test_children_of_one_parent_stay_apart(spark):
    from arborlens.operators.hierarchy import _resolve, busy_parents

    rows = [(f"n{i}", "hub" if i % 2 else f"n{i // 2}") for i in range(2, 20000)] + [("hub", "top")]
    links = spark.createDataFrame(rows, "node string, parent string").repartition(8)
    busy = busy_parents(links)
    assert busy == ["hub"]
    known = spark.createDataFrame([("hub", "top", 1, ["top", "hub"])], "node string, root_node string, depth bigint, path array<string>")
    records = links.selectExpr("node", "parent", "1L AS dist", "array() AS via").withColumn("via", F.col("via").cast("array<string>"))
    found = _resolve(records, known, busy).where(F.col("depth") == 2)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 9999 and max(sizes) <= 1.5 * sum(sizes) / len(sizes) and len(sizes) == 8
    chains = {f"a{i:03}": "hub" for i in range(60)} | {f"b{i:03}": f"a{i:03}" for i in range(60)} | {f"c{i:03}": f"b{i:03}" for i in range(60)}
    check_forest(spark, chains | {"hub": "top"})


def test_descendants_and_links(spark):
    edges = [("contains", "a", "b"), ("child_of", "b", "r"), ("contains", "b", "c"), ("contains", None, "d"), ("contains", "b", None), ("calls", "q", "a"), ("contains", "b", "c")]
    links = parent_links(spark.createDataFrame(edges, "kind string, source string, target string"), ["child_of"], ["contains"])
    assert {tuple(r) for r in links.collect()} == {("b", "r"), ("c", "b")}
    found = descendants(hierarchy(links, with_paths=True))
    assert {tuple(r) for r in found.collect()} == {("r", "b", 1), ("r", "c", 2), ("b", "c", 1)}
    empty = spark.createDataFrame([(None, "x"), ("y", None)], "node string, parent string")
    assert hierarchy(empty).count() == 0


# --- 4 --------------------------------------------------------------------------

REFS = [(1, "a", "x"), (2, "a", None), (3, None, "x"), (4, None, None), (5, "q", "x"), (6, "q", None), (7, "a", "x"), (8, "", "x")]
PARENTS = [("a", "x"), ("a", "x"), ("b", None), (None, None)]


@pytest.mark.parametrize("match, wanted", [("simple", {5, 8}), ("full", {2, 3, 5, 6, 8}), ("partial", {5, 6, 8}), ("exact", {2, 3, 5, 6, 8})])
def test_match_semantics(spark, match, wanted):
    refs = spark.createDataFrame([(*r, "c") for r in REFS], "row_id bigint, f string, s string, ref_0 string")
    parents = spark.createDataFrame(PARENTS, "f string, s string")
    assert {r.row_id for r in orphan_rows(refs, parents, ["f", "s"], ["row_id"], match).collect()} == wanted
    assert orphan_rows(refs.where("false"), parents, ["f", "s"], ["row_id"], match).count() == 0
    checked = 8 - {"simple": 4, "full": 1, "partial": 1, "exact": 1}[match]
    assert orphan_rows(refs, parents.where("false"), ["f", "s"], ["row_id"], match).count() == checked


def test_hot_keys_and_repeats(spark):
    rows = [(i, "gone") for i in range(3000)] + [(9000 + i, "there") for i in range(3000)] + [(20000 + i, f"k{i}") for i in range(50)] + [(1, "gone")]
    refs = spark.createDataFrame(rows, "row_id bigint, k string")
    parents = spark.createDataFrame([("there",), *[(f"k{i}",) for i in range(0, 50, 2)]], "k string")
    got = Counter(r.row_id for r in orphan_rows(refs, parents, ["k"], ["row_id"]).collect())
    assert got == Counter([i for i, k in rows if k == "gone" or k in {f"k{i}" for i in range(1, 50, 2)}])
    counted = {r.k: r.n_rows for r in orphan_keys(count_keys(refs, ["k"]), parents, ["k"]).collect()}
    assert counted["gone"] == 3001 and "there" not in counted


# --- 5 --------------------------------------------------------------------------


def skewed(spark, n=20000):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else "warm" if i % 11 == 0 else None if i % 97 == 0 else f"k{rng.randint(0, 900)}", rng.randint(1, 9), i, rng.choice(["s", "t", None, f"v{i % 500}"])) for i in range(n)]
    rows += rows[:50]
    return rows, spark.createDataFrame(rows, "k string, load bigint, id bigint, src string").repartition(6)


def test_stats_against_brute_force(spark):
    rows, frame = skewed(spark)
    wanted = defaultdict(lambda: [0, (-1, -1), set()])
    for k, load, i, src in rows:
        if k is not None:
            w = wanted[k]
            w[0] += 1
            w[1] = max(w[1], (load, i))
            w[2] |= {src} - {None}
    plan = plan_load(frame, "k", 8)
    got = {r.record_key: (r.n_rows, (r.newest_stamp, r.newest_id), r.n_distinct) for r in balanced_stats(frame, "k", "load", "id", "src", plan).collect()}
    assert got == {k: (n, top, len(s)) for k, (n, top, s) in wanted.items()}
    assert set(plan.large) == {"hot"} and plan.total == len(rows)
    assert max(plan.loads) <= 1.25 * sum(plan.loads) / 8


def test_rows_spread_as_planned(spark):
    from arborlens.operators.skew import fragment

    _, frame = skewed(spark)
    plan = plan_load(frame, "k", 8)
    sizes = [r["count"] for r in fragment(frame, "k", plan).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.35 * sum(sizes) / 8


def test_join_against_brute_force(spark):
    rows, frame = skewed(spark, 5000)
    side = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("none", 4), (None, 5)], "k string, v bigint")
    near = defaultdict(list)
    for k, v in [("hot", 1), ("k1", 2), ("k1", 3), ("none", 4)]:
        near[k].append(v)
    wanted = Counter((k, load, i, src, v) for k, load, i, src in rows for v in (near.get(k) or [None] if k is not None else [None]))
    assert Counter(map(tuple, balanced_join(frame, side, "k", 6).select("k", "load", "id", "src", "v").collect())) == wanted
    inner = balanced_join(frame, side, "k", 6, "inner")
    assert inner.count() == sum(n for (*_, v), n in wanted.items() if v is not None)


def test_empty_and_single_key(spark):
    frame = spark.createDataFrame([], "k string, load bigint, id bigint, src string")
    assert balanced_stats(frame, "k", "load", "id", "src").count() == 0
    one = spark.createDataFrame([("a", None, None, None)] * 500, frame.schema)
    assert [tuple(r) for r in balanced_stats(one, "k", "load", "id", "src").collect()] == [("a", 500, None, None, 0)]
