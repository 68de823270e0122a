from collections import Counter, defaultdict

from arborlens.llm.mixing import document_sizes, mix, share_report

SIZES = "doc_id bigint, source string, n_tokens bigint, text_key string"
TARGETS = "source string, target_share double, max_repeats bigint"


def rows_of(n, source, tokens, first=0):
    return [(first + i, source, tokens(i), f"{source}{i}") for i in range(n)]


def test_shares_are_met_to_the_token(spark):
    data = rows_of(700, "a", lambda i: i % 13 + 1) + rows_of(90, "b", lambda i: i % 7 + 1, 1000) + rows_of(5, "c", lambda i: 50, 2000)
    sizes = spark.createDataFrame(data, SIZES).repartition(5)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.19, 8), ("nothing", 0.01, 3)], TARGETS)
    mixed, plan = mix(sizes, targets, range_rows=20)
    rows = mixed.collect()
    size = {d: n for d, _, n, _ in data}
    taken, uses, cut = Counter(), Counter(), defaultdict(int)
    for r in rows:
        taken[r.source] += r.n_tokens
        uses[r.doc_id] += 1
        cut[r.source] += r.n_tokens != size[r.doc_id]
    goal = sum(p["wanted"] for p in plan)
    for p in plan:
        assert taken[p["source"]] == p["budget"] == p["wanted"]
        assert abs(taken[p["source"]] - goal * p["target_share"] / 0.99 * (p["size"] > 0)) <= 2
        assert cut[p["source"]] <= 1
    assert all(n <= {"a": 1, "b": 4, "c": 8}[s] for d, s, _, _ in data for n in [uses[d]])
    report = {r.source: r for r in share_report(mixed, plan).collect()}
    assert report["nothing"].tokens == 0 and abs(report["a"].actual_share - 0.5 / 0.99) < 1e-3


def test_same_result_for_any_layout(spark):
    data = rows_of(300, "a", lambda i: i % 5 + 1) + rows_of(300, "b", lambda i: 2, 1000)
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 2)], TARGETS)
    results = [sorted(map(tuple, mix(spark.createDataFrame(data, SIZES).repartition(n), targets, range_rows=k)[0].collect())) for n, k in ((1, 1000), (7, 13))]
    assert results[0] == results[1]


def test_capped_source_falls_short(spark):
    sizes = spark.createDataFrame(rows_of(10, "a", lambda i: 10) + rows_of(2, "b", lambda i: 10, 100), SIZES)
    mixed, plan = mix(sizes, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS), total_tokens=160)
    report = {r.source: r for r in share_report(mixed, plan).collect()}
    assert (report["a"].tokens, report["a"].is_short) == (80, False)
    assert (report["b"].tokens, report["b"].is_short, report["b"].epochs) == (40, True, 2)


def test_copies_count_as_one_text(spark):
    sizes = spark.createDataFrame([(i, "a", 10, "same") for i in range(9)] + [(20, "a", 10, "other")], SIZES)
    rows = mix(sizes, spark.createDataFrame([("a", 1.0, 3)], TARGETS))[0].collect()
    assert Counter(r.doc_id for r in rows) == {0: 3, 20: 3}


def test_nulls_and_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, None), (None, 0.5, 1), ("z", None, 1)], TARGETS)
    sizes = spark.createDataFrame([(None, "a", 3, "k"), (1, None, 3, "l"), (2, "a", None, "m"), (3, "q", 3, "n"), (4, "a", 0, "o")], SIZES)
    assert [tuple(r)[:4] for r in mix(sizes, targets)[0].collect()] == [("a", None, 0, 3)]
    assert mix(sizes.where("false"), targets)[0].count() == 0
    assert mix(sizes, targets.where("false"))[0].count() == 0


def test_documents(spark):
    docs = spark.createDataFrame(
        [(1, "hello world", " Design-Note ", 1), (2, "", "code", 1), (3, None, "code", 1)],
        "doc_id bigint, text string, source string, n_tokens bigint",
    )
    rows = {r.doc_id: r for r in document_sizes(docs).collect()}
    assert set(rows) == {1, 2} and rows[1].source == "design_note" and (rows[1].n_tokens, rows[2].n_tokens) == (2, 0)
