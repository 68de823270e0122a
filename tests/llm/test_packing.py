import random
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from arborlens.llm.packing import OpenBins, fill_report, pack, pack_texts

LIMITS = "limit_name string, max_tokens bigint"


def check(rows, sizes, capacity):
    """Every item whole or split only above the capacity; no container over it, no two pieces on the same place."""
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start_token, r.n_tokens))
        bins[r.container_id].append((r.container_offset, r.n_tokens))
    assert set(got) == set(sizes)
    for doc, pieces in got.items():
        pieces.sort()
        assert sum(n for _, n in pieces) == sizes[doc]
        assert len(pieces) == max(1, -(-sizes[doc] // capacity))
        at = 0
        for start, n in pieces:
            assert start == at
            at += n
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset >= at
            at = offset + n
        assert at <= capacity
    return bins


def test_random_items_over_many_shards_and_levels(spark):
    random.seed(1)
    sizes = {i: random.choice([0, 1, 7, 64, 65, 200, random.randint(0, 90)]) for i in range(3000)}
    items = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([("a", 64), ("b", 100), ("none", None)], LIMITS)
    rows = pack(items, limits, open_bins=8, shard_items=40).collect()
    for name, capacity in (("a", 64), ("b", 100)):
        bins = check([r for r in rows if r.limit_name == name], sizes, capacity)
        alone = sum(n > capacity / 2 for parts in bins.values() for _, n in parts)  # no two of these share a container
        assert len(bins) <= 1.12 * max(sum(sizes.values()) / capacity, alone) + 8
    assert {r.limit_name for r in rows} == {"a", "b"}


def test_sharding_wastes_no_more_than_one_shard(spark):
    items = spark.range(4000).selectExpr("id as doc_id", "1 + pmod(hash(id), 50) as n_tokens")
    limits = spark.createDataFrame([("a", 512)], LIMITS)
    one = fill_report(pack(items, limits, shard_items=10**6), limits).first()
    many = fill_report(pack(items, limits, shard_items=100), limits).first()
    assert one.n_tokens == many.n_tokens and many.n_containers <= one.n_containers * 1.02 + 1


def test_nulls_empty_and_repeated_rows(spark):
    limits = spark.createDataFrame([("a", 10)], LIMITS)
    assert pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), limits).count() == 0
    items = spark.createDataFrame([(None, 4), (1, 4), (1, 4), (2, None), (3, 0)], "doc_id bigint, n_tokens bigint")
    rows = pack(items, limits).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 4), (1, 4), (1, 4), (3, 0)]
    assert pack(items, limits.where("false")).count() == 0


def test_texts_with_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "one two three", "x", 9), (2, "", "y", 9), (3, None, "z", 9), (4, "word " * 5000, None, 9)],
        "doc_id bigint, text string, bin string, n_tokens bigint",
    )
    rows = pack_texts(docs, spark.createDataFrame([("a", 512)], LIMITS)).collect()
    assert {r.doc_id for r in rows} == {1, 2, 4}
    assert sum(r.n_tokens for r in rows if r.doc_id == 4) == 5001


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=80), st.integers(1, 5))
def test_open_bins_take_the_best_fit(sizes, most):
    bins, model, number = OpenBins(30, most), {}, 0
    for size in sizes:
        fitting = [free for free in model.values() if free >= size]
        got, offset = bins.place(size)
        if fitting:
            assert 30 - offset == min(fitting) and model[got] == min(fitting)
            model[got] -= size
        else:
            if size < 30 and len(model) == most:
                fullest = min(model.values())
                gone = next(k for k, v in model.items() if v == fullest and k not in {n for n, _ in bins.remaining()})
                del model[gone]
            model[got] = 30 - size
        if not model[got]:
            del model[got]
        assert len(model) <= most
        assert sorted((n, 30 - f) for n, f in model.items()) == sorted(bins.remaining())
