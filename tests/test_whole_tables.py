import random
from collections import Counter

import pytest

from arborlens.model import HIGH_KINDS
from arborlens.plans import analyses, groups, ingest, lookups, searches

SYMBOLS = (
    "symbol_id bigint, qualified_name string, name string, kind string, file_path string, line_start bigint, line_end bigint, visibility string, "
    "is_exported boolean, is_async boolean, is_test boolean, decorators array<string>, signature string, updated_at bigint, load_id bigint"
)
EDGES = "edge_id bigint, kind string, source string, target string, metadata string, load_id bigint"


def rows_of(rng):
    spans = []
    for i in range(60):
        first = rng.randint(1, 80)
        spans.append((f"f{i % 4}.py::s{i:02}", f"f{i % 4}.py", first, first + rng.choice([0, 1, 2, 5, 9, 40])))
    names = [s[0] for s in spans] + ["Aa.dangling", "Ab.dangling"]
    links = {(rng.choice(["calls", "extends", "type_reference"]), rng.choice(names), rng.choice(names)) for _ in range(150)}
    return spans, sorted(links)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    """A folder with small tables, and the same rows in Python."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spans, links = rows_of(random.Random(7))
    full = [(i, q, q.split("::")[1], "function", f, a, b, "private", False, False, int(q[-1]) < 3, [], None, 5, 1) for i, (q, f, a, b) in enumerate(spans)]
    spark.createDataFrame(full, SYMBOLS).write.parquet(f"{folder}/symbols.parquet")
    spark.createDataFrame([(i, *e, None, 1) for i, e in enumerate(links)], EDGES).write.parquet(f"{folder}/edges.parquet")
    return folder, spans, links


def brute_hunks(spans):
    return [(f, a, (b - a + 1) // 2) for _, f, a, b in spans if b > a]


def brute_touched(spans):
    hunks = brute_hunks(spans)
    return {(q, f) for q, f, a, b in spans if any(g == f and a <= s + max(n, 1) - 1 and s <= b for g, s, n in hunks)}


def test_hunks_of_every_span(spark, graph):
    folder, spans, links = graph
    got = sorted(tuple(r) for r in lookups.diff_hunks(spark, folder).select("file", "new_start", "new_count").collect())
    assert got == sorted(brute_hunks(spans)) and any(b - a < 30 for _, _, a, b in spans)
    assert {tuple(r) for r in lookups.diff_changed_symbols(spark, folder).collect()} == brute_touched(spans)
    parsed = groups.parsed_diffs(spark, folder).select("file", "new_start", "new_count").collect()
    assert sorted(tuple(r) for r in parsed) == sorted(brute_hunks(spans))


def brute_reach(links, start, depth):
    seen, front = {start: 0}, {start}
    for d in range(1, depth + 1):
        front = {b for _, a, b in links if a in front and b not in seen}
        seen |= dict.fromkeys(front, d)
    return {(start, n, d) for n, d in seen.items() if d}


def test_impact_of_every_span(spark, graph):
    folder, spans, links = graph
    kept = {(r.kind, r.source, r.target) for r in lookups._graph(spark, folder, 1).collect()}
    want = set().union(*(brute_reach(kept, q, 2) for q, _ in brute_touched(spans)))
    assert {tuple(r) for r in lookups.diff_impact(spark, folder).select("target", "node", "depth").collect()} == want


def kept_edges(spark, folder, rank):
    return {(r.kind, r.source, r.target) for r in lookups._graph(spark, folder, rank).collect()}


def test_searches_from_every_symbol(spark, graph):
    folder, spans, links = graph
    names = [q for q, *_ in spans]
    wide = kept_edges(spark, folder, 0)
    for query, depth in ((lookups.bfs_forward_d3, 3), (lookups.bfs_zero_depth, 1), (lookups.blast_radius, 4)):
        want = set().union(*(brute_reach(wide, q, depth) for q in names))
        found = query(spark, folder)
        assert {tuple(r) for r in found.select(found.columns[0], "node", "depth").collect()} == want
    high = kept_edges(spark, folder, 3)
    want = set(names).union(*({n for _, n, _ in brute_reach(high, q, 99)} for q in names))
    assert {r.node for r in lookups.dfs_reachable(spark, folder).collect()} == want


def test_scores_of_every_source(spark, graph):
    folder, spans, links = graph
    high = [e for e in links if e[0] in HIGH_KINDS]
    want = {}
    for start in {a for _, a, _ in high}:
        near = {n for _, n, _ in brute_reach(links, start, 2)}
        sure = {n for _, n, _ in brute_reach(high, start, 3)}
        good = len(near & sure)
        want[start] = (round(good / len(near), 6) if near else 0, round(good / len(sure), 6) if sure else 0)
    assert len(want) > 20
    assert {r.scenario: (r.precision, r.recall) for r in searches.eval_blast(spark, folder).collect()} == want
    p, r = (sum(v[i] for v in want.values()) / len(want) for i in (0, 1))
    assert tuple(searches.eval_blast_f1(spark, folder).first()) == pytest.approx((p, r, 2 * p * r / (p + r)), abs=1e-5)


def test_flows_of_every_entry(spark, graph):
    folder, spans, links = graph
    near = [(a, b) for k, a, b in links if k in HIGH_KINDS]
    kinds = {r.qualified_name: r.entry_kind for r in analyses.entries(spark, folder).collect()}
    assert "test" in kinds.values()
    want, open_paths = [], [[q] for q in kinds]
    while open_paths:
        path = open_paths.pop()
        grown = [[*path, b] for a, b in near if a == path[-1] and b not in path] if len(path) < 4 else []
        open_paths += grown
        if not grown:
            want.append((path[0], " > ".join(path), len(path)))
    assert sorted(tuple(r) for r in analyses.flow_paths_d4(spark, folder).collect()) == sorted(want)
    totals = analyses.flow_totals_d4(spark, folder).first()
    assert (totals.n_flows, totals.n_entries, totals.max_depth) == (len(want), len(kinds), max(d for *_, d in want))
    counts = Counter(n for _, path, _ in want for n in path.split(" > "))
    assert {r.node: r.n_flows for r in analyses.flow_node_counts_d4(spark, folder).collect()} == counts
    target = "f1.py::s01"
    analyses.TARGET, old = target, analyses.TARGET
    try:
        got = sorted(tuple(r) for r in analyses.flows_through_target_d4(spark, folder).collect())
    finally:
        analyses.TARGET = old
    assert got == sorted(w for w in want if target in w[1].split(" > "))


def test_changed_files_of_the_last_run(spark, graph, tmp_path):
    folder, spans, links = graph
    feed = [
        ("f0.py", "aa", 1, 1), ("f1.py", "aa", 1, 1), ("f2.py", "aa", 1, 1), ("f3.py", "aa", 1, 1),
        ("f1.py", "bb", 2, 2),  # changed in an earlier run
        ("f2.py", "cc", 3, 3),  # its run failed, so it waits for run 4
        ("f3.py", "SHA256:AA", 9, 4), ("f0.py", "dd", 0, 4),  # touched only; older than the state
        ("f9.py", "ee", 5, 5),  # new, not changed
    ]
    for name in ("symbols", "edges"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{folder}/{name}.parquet")
    spark.createDataFrame([(p, "Python", *r) for p, *r in feed], "path string, language string, hash string, updated_at bigint, load_id bigint").write.parquet(f"{tmp_path}/files.parquet")
    runs = [(1, "succeeded"), (2, "succeeded"), (3, "failed"), (4, "succeeded"), (5, "succeeded")]
    spark.createDataFrame(runs, "run_id bigint, status string").write.parquet(f"{tmp_path}/index_runs.parquet")
    home = {q: f for q, f, *_ in spans}
    want = {home[a] for _, a, b in links if home.get(b) == "f2.py" and a in home} - {"f2.py"}
    assert want and {r.path for r in ingest.incremental_dependents(spark, str(tmp_path)).collect()} == want
    left = {(k, a, b) for k, a, b in links if "f2.py" not in (home.get(a), home.get(b))}
    got = ingest.removed_file_edges(spark, str(tmp_path)).select("kind", "source", "target")
    assert {tuple(r) for r in got.collect()} == left
