from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from arborlens.llm.splitting import CutLimit, Cutter, Stitcher, _following, _token_gap, candidates, safe_point, split_files, split_texts
from arborlens.llm.tokens import Tokenizer, load

TOKENIZER = Tokenizer()
LIMITS = [CutLimit("s", 64, 8), CutLimit("m", 128, 0)]


def size(text):
    return len(load(TOKENIZER).encode_ordinary(text))


def check(texts, pieces, limits=LIMITS):
    groups = defaultdict(list)
    for p in pieces:
        groups[p.limit_name, p.doc_id].append(p)
    wanted = {(x.name, d) for d, t in texts.items() for x in limits if t and size(t) > x.max_tokens}
    assert set(groups) == wanted
    for (name, doc), parts in groups.items():
        limit = next(x for x in limits if x.name == name)
        parts.sort(key=lambda p: p.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert parts[0].start_char == 0 and parts[-1].end_char == len(texts[doc])
        for p in parts:
            assert texts[doc][p.start_char : p.end_char] == p.text
            assert p.n_tokens == size(p.text) <= limit.max_tokens
        for a, b in zip(parts, parts[1:]):
            assert a.start_char < b.start_char <= a.end_char
            shared = size(texts[doc][b.start_char : a.end_char])
            assert shared == 0 if not limit.overlap_tokens else limit.overlap_tokens <= shared <= limit.overlap_tokens + 20


PROSE = "The span may arrive before its offset. It is rebuilt then!\n\n  def fetch(x):\r\n      return x[0]\n" * 40
WIDE = "索引は毎晩作り直される。変更がなければ、何も起きない！次の行へ" * 60
TEXTS = {
    1: PROSE,
    2: WIDE,
    3: "abc123_" * 900,
    4: "x" * 7000,
    5: "\n" * 3000 + "end",
    6: "  \t " * 1200 + "end",
    7: "short text",
    8: "",
    9: "😀 grüße — naïve word. " * 300,
    10: None,
    11: "don't we'll it's " * 500,
}


@pytest.mark.parametrize("range_bytes", [1 << 20, 1000, 100, 16])
def test_pieces_hold_for_any_range(spark, range_bytes):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in TEXTS.items()], "doc_id bigint, text string, range_no string")
    check({d: t for d, t in TEXTS.items()}, split_texts(docs, LIMITS, range_bytes=range_bytes).collect())


def test_ranges_do_not_change_the_pieces(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    results = [sorted(map(tuple, split_texts(docs, LIMITS, range_bytes=r).collect())) for r in (1 << 20, 1500, 333, 64)]
    assert all(r == results[0] for r in results)


def test_texts_just_beyond_a_range(spark):
    texts = {n: ("word " * 7000)[: n - 1] + "." for n in (32_767, 32_768, 32_769)} | {5: "é" * 40_000, 6: "a b" + "c" * 70_000 + " d" * 300}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    pieces = split_texts(docs, LIMITS).collect()
    check(texts, pieces)
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, split_texts(docs, LIMITS, range_bytes=1 << 20).collect()))


def test_files_by_byte_ranges(spark, tmp_path):
    texts = {d: t for d, t in TEXTS.items() if t is not None} | {20: PROSE * 30}
    for d, t in texts.items():
        (tmp_path / f"{d}.txt").write_bytes(t.encode())
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    wanted = sorted(map(tuple, split_texts(docs, LIMITS).collect()))
    for range_bytes in (1 << 20, 700):
        rows = split_files(spark, [str(tmp_path)], LIMITS, range_bytes=range_bytes).collect()
        assert sorted((r.limit_name, int(r.path.rsplit("/", 1)[1][:-4]), *r[2:]) for r in rows) == wanted
    (tmp_path / "bad.bin").write_bytes(b"\xff\x80 caf\xc3" * 3000)
    bad = [sorted(map(tuple, split_files(spark, [str(tmp_path / "bad.bin")], LIMITS, range_bytes=r).collect())) for r in (1 << 20, 777)]
    assert bad[0] == bad[1] and all(p[5] == size(p[6]) <= 128 for p in bad[0])


def test_cuts_prefer_strong_boundaries(spark):
    text = "".join(f"Line {i} of the report has some words.\n" + ("\n" if i % 6 == 5 else "") for i in range(60))
    rows = split_texts(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), [CutLimit("s", 100, 0)]).collect()
    assert all(text[p.end_char : p.end_char + 2] == "\n\n" for p in rows if p.end_char < len(text))


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, PROSE), (None, PROSE)], "doc_id bigint, text string")
    for size_of_range in (100_000, 900):
        rows = split_texts(docs, LIMITS, range_bytes=size_of_range).collect()
        assert len(rows) == 2 * len({tuple(r) for r in rows}) and all(r.doc_id is None for r in rows)
    assert split_texts(docs.where("false"), LIMITS).count() == 0
    assert split_texts(docs, []).count() == 0


def test_impossible_overlap_is_refused(spark):
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), [CutLimit("bad", 64, 60)])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1.'\n\r\té。漢、　😀-_sT"), max_size=300))
def test_tokens_between_candidates_are_exact(text):
    offsets, counts, strengths = candidates(text, TOKENIZER, 4)
    assert offsets[-1] == len(text) and counts[-1] == size(text)
    previous = (0, 0)
    for offset, count in zip(offsets.tolist(), counts.tolist()):
        assert size(text[:offset]) == count
        assert size(text[previous[0] : offset]) == count - previous[1]
        previous = (offset, count)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1.'\n\té。漢s"), min_size=2, max_size=120), st.integers(1, 100))
def test_no_token_straddles_a_safe_point(text, begin):
    data = text.encode()
    point = safe_point(lambda a, b: data[a:b], begin, len(data))
    assert begin <= point or point == len(data)
    head, tail = data[:point].decode(), data[point:].decode()
    assert size(head) + size(tail) == size(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1.'\r\n\té。、漢s😀_"), min_size=2, max_size=400), st.integers(1, 60))
def test_stitched_tables_are_those_of_the_whole(text, range_bytes):
    data, gap = text.encode(), 4
    read = lambda a, b: data[a:b]
    limits, n = [CutLimit("s", 24, 5)], -(-len(data) // range_bytes)
    tokens = load(TOKENIZER).encode_ordinary(text)
    one, many, pieces = Stitcher(limits, gap), Stitcher(limits, gap), []
    whole = [*one.feed(*candidates(text, TOKENIZER, gap, tokens), len(text), len(tokens)), *one.finish()]
    bounds = [safe_point(read, k * range_bytes, len(data)) for k in range(n)] + [len(data)]
    for a, b in zip(bounds, bounds[1:]):
        own = data[a:b].decode()
        if own:
            after = _following(read, b, len(data)) if b < len(data) else None
            table = candidates(own, TOKENIZER, gap, first=a == 0, after=after)
            pieces += many.feed(*table, len(own), int(table[1][-1]))
    assert [*pieces, *many.finish()] == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word ", "two\n", "end. ", "漢字", "\n\n", "aVeryLongIdentifierName"]), max_size=400))
def test_cutter_fed_at_once_or_bit_by_bit(words):
    text, limit = "".join(words), CutLimit("s", 48, 6)
    gap = _token_gap([limit])
    table = candidates(text, TOKENIZER, gap)
    one = Cutter(limit, gap)
    whole = [*one.feed(*table), *one.finish(len(text), int(table[1][-1]))]
    many, parts = Cutter(limit, gap), []
    for i in range(len(table[0])):
        parts += many.feed(*(column[i : i + 1] for column in table))
    assert whole == [*parts, *many.finish(len(text), int(table[1][-1]))]
