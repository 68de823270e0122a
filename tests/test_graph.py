import random
from array import array
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlens.functions.names import file_stem, glob_pattern, language_of, matches_any, name_symbol, pascal, segments
from arborlens.model import CloneConfig, DeadCodeConfig, FlowConfig, RiskConfig, confidence_rank, parse_confidence
from arborlens.operators import clones as C, leiden as L
from arborlens.operators.analysis import coupling, dead_layers, entry_points, risk_files, risk_stats, sensitivity, test_gaps
from arborlens.operators.symbolgraph import changed_symbols, current_edges, current_symbols, find_by_name, find_cards
from arborlens.operators.communities import cards, detect, modularity, weights
from arborlens.operators.components import connected_components
from arborlens.operators.evaluate import blast_scores, macro_f1, precision_at, reciprocal_ranks
from arborlens.operators.flows import _by_level, betweenness, capped_flows, flow_paths, flows_through
from arborlens.operators.search import fuse, hybrid_search, kind_boosts, nearest_in_blocks, phrase_search, query_terms
from arborlens.operators.traversal import bfs, bfs_last, dfs_order, reachable
from arborlens.operators.workgraph import Dependencies

test_gaps.__test__ = False
SYMBOL = (
    "qualified_name string, name string, kind string, file_path string, line_start bigint, line_end bigint, visibility string, "
    "is_exported boolean, is_test boolean, decorators array<string>, signature string"
)


def symbols(spark, *rows):
    full = []
    for r in rows:
        r = {"qualified_name": r} if isinstance(r, str) else r
        q = r["qualified_name"]
        base = {"name": q.split("::")[-1], "kind": "function", "file_path": q.split("::")[0], "line_start": 1, "line_end": 9, "visibility": "private", "is_exported": False, "is_test": False, "decorators": [], "signature": None}
        base |= r
        full.append(tuple(base[c.split()[0]] for c in SYMBOL.split(", ")))
    return spark.createDataFrame(full, SYMBOL)


def edges(spark, *rows):
    full = [(i, *(r if len(r) == 3 else ("calls", *r))) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, "edge_id bigint, kind string, source string, target string")


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


def test_current_rows(spark):
    rows = [(1, "q", "a", 5), (2, "q", "b", 5000 * 10**9), (3, "q", "c", None), (4, None, "d", 9), (5, "r", "e", None)]
    frame = spark.createDataFrame(rows, "symbol_id bigint, qualified_name string, name string, updated_at bigint")
    assert {tuple(r) for r in current_symbols(frame, ["name"]).collect()} == {("q", "b"), ("r", "e")}
    raw = [(1, "Calls", " a ", ".\\b"), (2, "calls", "a", "./b"), (3, "TypeReference", "a", None), (4, "BarrelReExportAll", "x", "y"), (0, "calls", "a", "b")]
    got = current_edges(spark.createDataFrame(raw, "edge_id bigint, kind string, source string, target string"))
    assert {tuple(r) for r in got.collect()} == {(0, "calls", "a", "b"), (4, "barrel_re_export_all", "x", "y")}


def brute_bfs(rows, start, depth):
    near = defaultdict(list)
    for i, (kind, a, b) in enumerate(rows, 1):
        near[a].append((i, kind, b))
    seen, queue, out = {start}, deque([(start, [start])]), {}
    while queue:
        node, path = queue.popleft()
        if len(path) > max(depth, 1):
            continue
        for _, kind, b in near[node]:
            if b not in seen:
                seen.add(b)
                out[b] = (len(path), kind, [*path, b])
                queue.append((b, [*path, b]))
    return out


def test_bfs_like_a_queue(spark):
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(rng.choice(["calls", "extends"]), f"n{rng.randint(0, 12)}", f"n{rng.randint(0, 12)}") for _ in range(40)]
        got = {r.node: (r.depth, r.edge_kind, r.path) for r in bfs(edges(spark, *rows), starts(spark, "n0", None), "forward", 4).collect()}
        assert got == brute_bfs(rows, "n0", 4)


def test_bfs_edges_of_meaning(spark):
    links = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"))
    assert {(r.node, r.depth) for r in bfs(links, starts(spark, "a")).collect()} == {("b", 1), ("c", 2)}
    assert {r.node for r in bfs(links, starts(spark, "a"), max_depth=0).collect()} == {"b"}
    assert {r.node for r in bfs(links, starts(spark, "a"), "backward", 1).collect()} == {"c"}
    assert bfs(links.where("false"), starts(spark, "a")).count() == 0
    assert {r.node for r in reachable(links, starts(spark, "b")).collect()} == {"a", "b", "c"}
    order = dfs_order(edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("d", "c")), starts(spark, "a")).orderBy("position").collect()
    assert [(r.node, r.depth) for r in order] == [("b", 1), ("d", 2), ("c", 3)]
    with pytest.raises(ValueError):
        dfs_order(links, starts(spark, "a"), max_nodes=1)


def test_workers_search_as_joins_do(spark):
    """Searches of workers that hold the graph give what those in DataFrames give, also for repeated edges, loops and names out of the graph."""
    rng = random.Random(11)
    names = [f"n{i:02}" for i in range(40)]
    kinds = ["calls", "contains", "imports_from", "other"]
    rows = [(rng.choice(kinds), rng.choice(names), rng.choice(names)) for _ in range(110)]
    links, own = edges(spark, *rows), starts(spark, *names, "n00", "away", None)
    for direction in ("forward", "backward"):
        for depth in (0, 1, 3, 9):
            rank = {r.kind: r.t for r in links.select("kind", confidence_rank(F.col("kind")).alias("t")).distinct().collect()}
            wanted = sorted((r.start, r.node, r.depth, str(rank[r.edge_kind])) for r in bfs(links, own, direction, depth).collect())
            got = bfs_last(links, own, direction, depth, confidence_rank(F.col("kind"))).collect()
            assert sorted((r.start, r.node, r.depth, str(r.tag)) for r in got) == wanted
        held, sent = (sorted(map(tuple, dfs_order(links, own, direction, task_links=limit).collect())) for limit in (1000, 0))
        assert held == sent and held
        most = max(sum(r[0] == s for r in held) for s in names)
        assert dfs_order(links, own, direction, max_nodes=most).count() == len(held)
        with pytest.raises(ValueError):
            dfs_order(links, own, direction, max_nodes=most - 1)
    assert bfs_last(links.where("false"), own, "forward", 2, F.lit(1)).count() == 0 == dfs_order(links.where("false"), own).count()


def test_betweenness_of_many_sources_at_once(spark):
    rng = random.Random(12)
    names = [f"n{i:03}" for i in range(150)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(400)] + [("n000", "n001")] * 3
    wanted = brute_between(names, pairs)
    got = {r.qualified_name: r.betweenness for r in betweenness(symbols(spark, *names), edges(spark, *pairs)).collect()}
    assert all(abs(got[n] - wanted[n]) < 1e-9 for n in names)
    ends = sorted({x for p in pairs for x in p})
    number = {name: i for i, name in enumerate(ends)}
    tails, heads = np.array(sorted((number[a], number[b]) for a, b in pairs)).T
    sums = Dependencies(len(ends), np.searchsorted(tails, np.arange(len(ends) + 1)), heads, cells=3 * len(ends))
    for k in range(0, len(ends), sums.width):
        sums.add(np.arange(k, min(k + sums.width, len(ends))))
    scale = (len(names) - 1) * (len(names) - 2)
    assert sums.width == 3 and all(abs(sums.total[number[n]] / scale - wanted[n]) < 1e-9 for n in ends)


def test_lookups(spark):
    own = symbols(spark, "a::foo", "a::Foo_bar", "a::axbycz", "b::__init__", "b::__init_extra")
    assert {r.name for r in find_by_name(own, "Foo").collect()} == {"foo", "Foo_bar"}
    assert {r.name for r in find_by_name(own, "foo").collect()} == {"foo"}
    assert {r.name for r in find_by_name(own, "__init").collect()} == {"__init__", "__init_extra"}
    links = edges(spark, *[(f"c{i}", "a::foo") for i in range(5)], ("tested_by", "t", "a::foo"), ("a::foo", "z"))
    card = find_cards(own, links, "foo").first()
    assert (card.n_callers, card.callers, card.n_callees, card.callees, card.n_tests, card.tests) == (5, "c0, c1, c2", 1, "z", 1, "t")
    spans = symbols(spark, {"qualified_name": "f::a", "line_start": 1, "line_end": 5}, {"qualified_name": "f::b", "line_start": 6, "line_end": 9})
    hunks = spark.createDataFrame([("f", 5, 0), ("f", 4, 2), ("g", 1, 99)], "file string, new_start bigint, new_count bigint")
    assert [r.qualified_name for r in changed_symbols(spans, hunks).collect()] == ["f::a"]


def brute_between(names, pairs):
    near = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
    total = dict.fromkeys(names, 0.0)
    for s in names:
        depth, sigma, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        before = defaultdict(list)
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        owed = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                owed[v] += sigma[v] / sigma[w] * (1 + owed[w])
            if w != s:
                total[w] += owed[w]
    n = len(names)
    return {k: v / ((n - 1) * (n - 2)) for k, v in total.items()}


def test_betweenness(spark):
    chain = betweenness(symbols(spark, *"abcde"), edges(spark, *zip("abcd", "bcde")))
    assert {r.qualified_name: round(r.betweenness, 6) for r in chain.collect()}["c"] == round(1 / 3, 6)
    rng = random.Random(4)
    names = [f"n{i}" for i in range(15)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(45)]
    links = edges(spark, *pairs, ("imports_from", "n1", "n2"))
    wanted = brute_between(names, pairs)
    for method in ("source", "level"):
        got = {r.qualified_name: r.betweenness for r in betweenness(symbols(spark, *names), links, method).collect()}
        assert all(abs(got[n] - wanted[n]) < 1e-9 for n in names)
    assert betweenness(symbols(spark, "a"), edges(spark).where("false")).first().betweenness == 0
    assert _by_level(edges(spark, ("a", "b")).select("source", "target")).count() >= 0


def brute_flows(entries, rows, config):
    near, out = defaultdict(list), []
    for a, b in rows:
        near[a].append(b)
    for e in entries:
        stack = [[e]]
        while stack and len(out) < config.max_flows:
            path = stack.pop()
            following = [n for n in near[path[-1]] if n not in path]
            if not following or len(path) >= config.max_depth:
                out.append(path)
            else:
                stack += [[*path, n] for n in following]
    return out


@pytest.mark.parametrize("cap", [1000, 7, 1])
def test_flows_like_a_stack(spark, cap):
    rng = random.Random(7)
    rows = [(f"n{rng.randint(0, 7)}", f"n{rng.randint(0, 7)}") for _ in range(16)]
    config = FlowConfig(max_depth=5, max_flows=cap)
    own = [{"qualified_name": f"n{i}", "name": "main"} for i in range(3)]
    found = entry_points(symbols(spark, *own), edges(spark, *rows))
    got = [r.path for r in capped_flows(found, edges(spark, *rows), config).collect()]
    assert sorted(got) == sorted(brute_flows(["n0", "n1", "n2"], rows, config))


def test_uncapped_flows(spark):
    entries = spark.createDataFrame([("a",)], "qualified_name string")
    links = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("imports_from", "b", "z"))
    assert sorted(r.path for r in flow_paths(entries, links).collect()) == [["a", "b", "c"], ["a", "c"]]
    assert sorted(r.path for r in flows_through("b", entries, links).collect()) == [["a", "b", "c"]]


def test_entry_points_and_dead_code(spark):
    own = symbols(
        spark,
        {"qualified_name": "m::Main", "name": "Main"},
        {"qualified_name": "m::t", "is_test": True},
        {"qualified_name": "m::test_x"},
        {"qualified_name": "m::h", "decorators": ["@App.Route('/')"]},
        {"qualified_name": "m::c", "decorators": ["@click.command"]},
        {"qualified_name": "m::pub", "is_exported": True, "visibility": "public"},
        {"qualified_name": "m::called", "is_exported": True, "visibility": "public"},
        {"qualified_name": "m::const", "is_exported": True, "visibility": "public", "kind": "const"},
        {"qualified_name": "db/migrations/x.py::up", "file_path": "db/migrations/x.py"},
        {"qualified_name": "m::dead"},
        {"qualified_name": "m::nulls", "is_exported": None, "is_test": None, "decorators": None, "visibility": None},
    )
    links = edges(spark, ("x", "m::called"))
    got = {r.qualified_name: (r.entry_kind, r.confidence) for r in entry_points(own, links).collect()}
    assert got == {
        "m::Main": ("main", 1.0), "m::t": ("test", 1.0), "m::test_x": ("test", 0.9), "m::h": ("http_handler", 1.0),
        "m::c": ("cli_command", 1.0), "m::pub": ("public_root", 0.7),
    }
    layers = {r.qualified_name: r.layer for r in dead_layers(own, links, DeadCodeConfig(exclude_globs=("m::nul*", "[bad"))).collect()}
    assert layers == {
        "m::Main": "entry_point", "m::t": "test", "m::test_x": "dead", "m::h": "entry_point", "m::c": "entry_point", "m::pub": "entry_point",
        "m::called": "alive", "m::const": "exported", "db/migrations/x.py::up": "migration", "m::dead": "dead", "m::nulls": "pattern",
    }


def test_risk_parts(spark):
    own = symbols(spark, "a::x", "a::authToken", {"qualified_name": "a::y", "decorators": ["@auth"]})
    links = edges(spark, ("a::x", "a::x"), ("a::x", "a::y"), ("contains", "a::x", "a::y"), ("tested_by", "t", "a::y"), ("a::x", "gone"))
    assert {r.qualified_name: r.degree for r in coupling(own, links).collect()} == {"a::x": 3, "a::authToken": 0, "a::y": 1}
    assert {r.qualified_name: r.test_gap for r in test_gaps(own, links).collect()} == {"a::x": 1.0, "a::authToken": 1.0, "a::y": 0.0}
    assert {r.qualified_name: r.sensitivity for r in sensitivity(own).collect()} == {"a::x": 0.0, "a::authToken": 1.0, "a::y": 0.0}
    assert RiskConfig(0, 0, 0, 0).weights() == (0.30, 0.25, 0.25, 0.20)
    scores = spark.createDataFrame([("p", "f", 0.1), ("q", "f", 0.5), ("r", "f", 0.9), ("b", "g", 0.0)], "qualified_name string, file_path string, composite double")
    three = risk_stats(scores.where("file_path = 'f'")).first()
    assert (three.symbols_scored, three.median_risk, three.avg_risk, three.p90_risk) == (3, 0.5, 0.5, 0.9)
    assert risk_stats(scores.where("false")).first().symbols_scored == 0
    assert {r.file_path: r.driver for r in risk_files(scores).collect()} == {"f": "r", "g": ""}


def test_names(spark):
    row = spark.createDataFrame([("src/a.b/Foo.spec.ts::HttpServer.get_URL", "src/a.b/Foo.spec.ts", "x/.hid", "noext")], "q string, p string, h string, n string").select(
        name_symbol(F.col("q")), file_stem(F.col("p")), file_stem(F.col("h")), language_of(F.col("n")), pascal(F.lit("type_alias")), segments(F.col("q"))
    )
    assert list(row.first()) == ["HttpServer.get_URL", "Foo.spec", ".hid", "Rust", "TypeAlias", ["src", "a", "b", "foo", "spec", "ts", "http", "server", "get", "url"]]
    import re

    for glob, text, hit in [("**/migrations/**", "a/migrations/b", 1), ("**/migrations/**", "migrations/b", 1), ("*.ts", "a/b.ts", 1), ("a?c", "abc", 1), ("{a,b}*", "bx", 1), ("[!a]b", "ab", 0), ("a.b", "axb", 0)]:
        assert bool(re.match(glob_pattern(glob), text)) == bool(hit), glob
    assert not spark.range(1).select(matches_any(F.lit("x"), [])).first()[0]
    assert parse_confidence("All") == 0 and parse_confidence("HIGH") == 3
    with pytest.raises(ValueError):
        parse_confidence("some")


def test_tokens_and_similarity(spark):
    code = "fn add(a, b) { a + b } // c\nx = 'q' # rest"
    tokens = spark.createDataFrame([(code,)], "t string").select(C.tokens_of(F.col("t")).alias("t"))
    assert tokens.first()[0] == ["fn", "add", "(", "a", ",", "b", ")", "{", "a", "+", "b", "}", "x", "=", "'", "q", "'"]
    assert tokens.select(C.normalized(F.col("t"))).first()[0][:12] == ["fn", "_1", "(", "_2", ",", "_3", ")", "{", "_2", "+", "_3", "}"]
    body = spark.createDataFrame([("a\nb\r\nc",)], "t string").select(C.body_of(F.col("t"), F.lit(2), F.lit(9)), C.body_of(F.lit(None).cast("string"), F.lit(1), F.lit(2)))
    assert list(body.first()) == ["b\nc", ""]


def test_similarity_join_against_brute_force(spark):
    rng = random.Random(2)
    items = [("g", f"i{n}", [rng.choice("abcdefg") for _ in range(rng.randint(0, 12))]) for n in range(60)]

    def jaccard(x, y):
        keys = set(x) | set(y)
        return sum(min(x.count(k), y.count(k)) for k in keys) / max(1, sum(max(x.count(k), y.count(k)) for k in keys))

    for t in (0.7, 0.95, 0.5):
        wanted = {(a, b): jaccard(x, y) for _, a, x in items for _, b, y in items if a < b and x and y and jaccard(x, y) >= t}
        got = {(r.a, r.b): r.similarity for r in C.similar_multisets(spark.createDataFrame(items, "`group` string, id string, tokens array<string>"), t).collect()}
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_similarity_join_in_blocks(spark):
    """The same pairs whatever the blocks, also of sizes that differ and of groups that share a block."""
    rng = random.Random(3)
    items = [(rng.choice("gh"), f"i{n:02}", [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 30))]) for n in range(50)]
    items += [(g, i + "x", [*t, "z"]) for g, i, t in items[::2]] + [("alone", "i", ["a"])]
    frame = spark.createDataFrame(items, "`group` string, id string, tokens array<string>")
    wanted = {}
    for g, a, x in items:
        for h, b, y in items:
            both = sum(min(x.count(k), y.count(k)) for k in set(x))
            if g == h and a < b and x and y and both / (len(x) + len(y) - both) >= 0.6:
                wanted[g, a, b] = both / (len(x) + len(y) - both)
    for block in (7, 1000):
        got = {(r.group, r.a, r.b): r.similarity for r in C.similar_multisets(frame, 0.6, block).collect()}
        assert got == pytest.approx(wanted) and got
    words = ["def", "a", "bb", "(", "7x", "_", "c"]
    texts = [(g, i, [rng.choice(words) for _ in range(12)]) for g, i, _ in items]
    frame = spark.createDataFrame(texts, "`group` string, id string, tokens array<string>")
    by_plan = C.similar_multisets(frame.withColumn("tokens", C.normalized(F.col("tokens"))), 0.8)
    one, other = ({(r.group, r.a, r.b): r.similarity for r in f.collect()} for f in (by_plan, C.similar_multisets(frame, 0.8, replaced=True)))
    assert one == other and one


def test_clones(spark):
    text = "def f(a):\n    b = a + 1\n    return b\n    # x\n\n"
    near = text.replace("a", "q").replace("b", "w")
    files = [("x.py", text), ("y.py", text), ("z.py", near), ("w.go", "totally other words here\n" * 6)]
    own = symbols(spark, *[{"qualified_name": f"{p}::f", "line_end": 6} for p, _ in files], {"qualified_name": "x.py::short", "line_end": 2})
    prints = C.fingerprints(own, edges(spark, ("imports_from", "x", "y")), CloneConfig())
    classes = C.clone_classes(prints, spark.createDataFrame(files, "path string, content string"))
    pairs = C.clone_pairs(classes)
    assert [(r.a, r.b, r.clone_type) for r in pairs.collect()] == [("x.py::f", "z.py::f", "type2")]
    links = {r.qualified_name: (r.n_type1, r.n_type2, r.n_structural) for r in C.clone_links(classes, pairs).collect()}
    assert links == {"x.py::f": (1, 1, 1), "y.py::f": (1, 1, 1), "z.py::f": (0, 2, 1), "w.go::f": (0, 0, 3)}
    clusters = C.clone_clusters(classes, pairs)
    assert {(r.cluster_id, r.representative, r.n_members) for r in clusters.collect()} == {(1, "w.go::f", 4)}
    assert C.clone_summary(classes, clusters, C.clone_links(classes, pairs)).first().duplication_pct == 100.0


def test_clone_sums_are_those_of_the_pairs(spark):
    """Links, clusters and their quality come out alike from pairs and from sums, and sums grow with the classes, not with the pairs."""
    rng = random.Random(4)
    words = ["def", "if", "(", ")", "7", "a", "b", "cc", "x1"]
    texts = [[rng.choice(words) for _ in range(9)] for _ in range(25)] + [["q", "(", str(k), ")"] + ["return", "1", "+"] * 12 for k in range(60)]
    texts += [["s"], []] + [["y"] * 20 + [chr(97 + k)] for k in range(20)]
    rows = [(b, g, f"s{i:03}{c}", t) for i, t in enumerate(texts) for c in ("", "x")[: 1 + i % 2] for b, g in [("b" if i % 5 else "c", "Go" if i % 3 else "Rust")]]
    first = {}
    for b, g, q, t in sorted(rows, key=lambda r: r[2]):
        first.setdefault((b, g, *t), q)
    rows = [(b, g, q, t, first[b, g, *t]) for b, g, q, t in rows]
    classes = spark.createDataFrame(rows, "bucket string, language string, qualified_name string, tokens array<string>, class_id string").cache()
    pairs = C.clone_pairs(classes).cache()
    assert {r.clone_type for r in pairs.collect()} == {"type1", "type2"}
    assert C.clone_sums(classes).count() < len(rows) < pairs.count() / 3
    sums = C.clone_sums(classes, block=7).cache()
    by = [sorted(C.clone_links(classes, p).collect()) for p in (pairs, sums)]
    assert by[0] == by[1]
    found = [C.clone_clusters(classes, p).cache() for p in (pairs, sums)]
    clusters = [sorted(f.collect()) for f in found]
    assert clusters[0] == clusters[1]
    quality = [sorted((r.cluster_id, r.n_matches, round(r.avg_similarity, 9), r.clone_type) for r in C.cluster_quality(f, classes, p).collect()) for f, p in zip(found, (pairs, sums))]
    assert quality[0] == quality[1]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randint(0, 80)}", f"n{rng.randint(0, 80)}") for _ in range(60)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*pairs, (None, "x")], "a string, b string")).collect()}
    assert got == {n: find(n) for n in list(parent)}


def test_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    own = symbols(spark, *[f"{c}{i}" for c in "ab" for i in range(5)], "alone")
    links = edges(spark, *cliques, ("a0", "a0"), ("a1", "a0"))
    found = {r.qualified_name: r.community_id for r in detect(own, links).collect()}
    assert len(found) == 10 and {frozenset(k for k in found if found[k] == c) for c in found.values()} == {frozenset(f"{c}{i}" for i in range(5)) for c in "ab"}
    pairs = weights(own, links)
    assert pairs.where("lo = 'a0' and hi = 'a1'").first().weight == 2
    partition = spark.createDataFrame([(n, n[0]) for n in found], "qualified_name string, community string")
    assert 0.4 < modularity(partition, pairs).first()[0] < 0.5
    card = {r.community: (r.inner_pairs, r.boundary_pairs) for r in cards(partition, pairs).collect()}
    assert card == {"a": (10, 1), "b": (10, 1)}
    assert detect(own, links.where("false")).count() == 0


def test_communities_are_refined(spark):
    """Both ways refine: communities are connected, and no two of them should be one."""
    of, degree = [0, 0, 0, 0], np.array([1, 1, 1, 1])
    apart = L._Graph(np.array([0, 2]), np.array([1, 3]), np.array([1, 1]), degree)
    parts = L._refined(apart, 1 / 4, [0, 1, 2, 3], of)
    assert parts[0] == parts[1] != parts[2] == parts[3]
    rng = random.Random(8)
    names = [f"n{i:02}" for i in range(60)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i] if rng.random() < (0.3 if i // 12 == names.index(b) // 12 else 0.02)]
    own, links = symbols(spark, *names), edges(spark, *pairs)
    for limit in (1000, 0):
        found = {r.qualified_name: r.community_id for r in detect(own, links, task_links=limit).collect()}
        assert found.keys() == {x for p in pairs for x in p}
        inner = [p for p in pairs if found[p[0]] == found[p[1]]]
        whole = connected_components(spark.createDataFrame(inner, "a string, b string")).groupBy("component").count().count()
        assert whole == len(set(found.values()))
        weight = {c: sum((found[a] == c) + (found[b] == c) for a, b in pairs) for c in found.values()}
        for x in weight:
            for y in weight:
                between = sum({found[a], found[b]} == {x, y} for a, b in pairs)
                assert x == y or between <= weight[x] * weight[y] / (2 * len(pairs)) + 1e-6
        part = spark.createDataFrame(list(found.items()), "qualified_name string, community string")
        assert modularity(part, weights(own, links)).first()[0] > 0.4


def test_local_moving_by_arrays(monkeypatch):
    """All nodes at once and hubs as arrays decide like node by node, and in the end no node is left that would move."""
    rng = np.random.default_rng(2)
    ends = np.unique(np.sort(np.concatenate([rng.integers(0, 600, (1500, 2)), np.column_stack([np.zeros(400, dtype=int), rng.integers(1, 600, 400)])]), axis=1), axis=0)
    lo, hi = ends[ends[:, 0] < ends[:, 1]].T
    weight = rng.integers(1, 4, len(lo))
    degree = (np.bincount(lo, weight, 600) + np.bincount(hi, weight, 600)).astype(np.int64)
    graph, scale = L._Graph(lo, hi, weight, degree), 1 / degree.sum()
    of = array("i", rng.integers(0, 40, 600).tolist())
    sums = array("q", np.bincount(np.array(of), degree, 600).astype(np.int64).tolist())
    inside = array("i", [c % 3 for c in of])
    best = []
    for hub in (10**6, 1):
        monkeypatch.setattr(L, "_HUB", hub)
        best.append([[L._best(graph, v, of, sums, scale, x) for v in range(600)] for x in (None, inside)])
    gain = lambda v, c, x: sum(w for u, w in zip(*graph.links(v)) if of[u] == c and (x is None or x[u] == x[v])) - scale * degree[v] * (sums[c] - (c == of[v]) * degree[v])
    for one, other, x in zip(*best, (None, inside)):
        assert all(a == b or gain(v, a, x) == pytest.approx(gain(v, b, x)) for v, (a, b) in enumerate(zip(one, other)))
        assert [a == c for a, c in zip(one, of)] == [b == c for b, c in zip(other, of)]
    assert L._restless(graph, of, sums, scale).tolist() == [a != c for a, c in zip(best[0][0], of)]
    for hub in (10**6, 200, 1):
        monkeypatch.setattr(L, "_HUB", hub)
        found, moved = L._moved(graph, scale, rng.permutation(600).tolist())
        sums = array("q", np.bincount(np.array(found), degree, 600).astype(np.int64).tolist())
        monkeypatch.setattr(L, "_HUB", 10**6)
        assert moved and [L._best(graph, v, found, sums, scale, None) for v in range(600)] == list(found)


def test_search(spark):
    own = symbols(spark, {"qualified_name": "a::User", "kind": "struct"}, {"qualified_name": "a::UserService", "kind": "class"}, {"qualified_name": "b::find_user", "signature": "(user name)"})
    assert [r.qualified_name for r in phrase_search(own, "User").collect()][0] == "a::User"
    assert [r.qualified_name for r in phrase_search(own, "user na").collect()] == ["b::find_user"]
    assert phrase_search(own, "").count() == phrase_search(own, '"*').count() == 0
    assert query_terms("x" * 499 + "é") == ["x" * 499]
    assert kind_boosts("User") == ["struct", "trait", "interface"] and kind_boosts("find_user") == ["function", "method"] and kind_boosts("a::B") == []
    first = hybrid_search(own, "User").first()
    assert first.qualified_name == "a::User" and first.score_source == "hybrid"
    assert hybrid_search(own, "").count() == 0
    lists = [spark.createDataFrame(rows, "qualified_name string, score double") for rows in ([("x", 3.0), ("y", 2.0)], [("y", 9.0)])]
    assert {r.qualified_name: round(r.score, 6) for r in fuse(lists).collect()} == {"x": round(1 / 61, 6), "y": round(1 / 62 + 1 / 61, 6)}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id bigint, v array<float>")
    near = nearest_in_blocks(vectors.where("id = 1"), vectors, "id", "v", 2, block=2).orderBy("position").collect()
    assert [(r.neighbour, round(r.score, 6)) for r in near] == [(2, 1.0), (3, 0.0)]


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x")], "query_id int, position int, item string")
    expected = spark.createDataFrame([(1, "y"), (1, "y"), (3, "z")], "query_id int, item string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert {r.query_id: r.reciprocal_rank for r in reciprocal_ranks(results, expected, queries).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    assert {r.query_id: r.precision for r in precision_at(results, expected, queries, 5).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    predicted = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b")], "scenario string, node string")
    truth = spark.createDataFrame([("s", "a"), ("s", "c"), ("t", "d")], "scenario string, node string")
    both = spark.createDataFrame([("s",), ("t",)], "scenario string")
    scores = {r.scenario: (round(r.precision, 4), r.recall) for r in blast_scores(predicted, truth, both).collect()}
    assert scores == {"s": (0.6667, 1.0), "t": (0.0, 0.0)}
    assert round(macro_f1(blast_scores(predicted, truth, both)).first().f1, 4) == round(2 * (1 / 3) * 0.5 / (1 / 3 + 0.5), 4)
