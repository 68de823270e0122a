"""Splitting oversized texts at natural boundaries, by byte ranges.

A text is cut into ranges at multiples of ``range_bytes``. Each range begins at
the first *safe point* at or after its multiple and ends where the next one
begins: a place that no token can straddle, where letters, digits or other signs
end and another class begins. A worker finds both by reading a few bytes past
the range's ends, so ranges are handled apart and their tokens are those of the
whole text. Files are read by offset and length, and nobody loads a whole one
(``split_files``). A text in a table cell is read with its row; one linear pass
cuts it into ranges (``split_texts``).

Each worker lists its range's candidate cuts with their strength and the tokens
up to them. The tables of a text are stitched in order: prefix sums of lengths
make offsets and token counts absolute, and one pass picks the cuts, keeping no
more than one piece's candidates. Pieces are emitted by offset: the ranges give
the fragments they hold. A text of one range has no neighbour to be stitched to,
so the worker that read it takes the same two steps at once; the pieces do not
depend on the size of the ranges (tested from 16 bytes to whole texts).

Why counts are exact: any run of tokens of a BPE encoding is the encoding of the
bytes it spells, and all candidates lie where the pre-tokenizer cuts a piece as
it cuts the whole, so the tokens of a piece are a difference of prefix sums. A
run of a single class (letters, say) is one word to the tokenizer, so its range
is as long as the run.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import materialize, task_count
from .tokens import Tokenizer, load

PARAGRAPH, LINE, SENTENCE, WORD, TOKEN = 4, 3, 2, 1, 0
#: The end of a text; a token's end near a range's end, which counts only if the stretch across it turns out to be long.
_END, _MAYBE = 5, -1
# White space of the pre-tokenizer's \s.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Signs that end a sentence, those of scripts without spaces, their clause signs, and closing signs.
_STOPS = [ord(c) for c in ".!?…。！？।؟"]
_WIDE_STOPS = [ord(c) for c in "。！？；"]
_WIDE_CLAUSES = [ord(c) for c in "、，："]
_CLOSERS = [ord(c) for c in "\"')]}’”」』"]


@dataclass(frozen=True)
class CutLimit:
    name: str
    max_tokens: int
    overlap_tokens: int


def _checked(limits: list[CutLimit], gap: int) -> None:
    for limit in limits:
        if limit.max_tokens < limit.overlap_tokens + gap + 10:
            raise ValueError(f"limit {limit.name}: {limit.max_tokens} tokens leave no room beside an overlap of {limit.overlap_tokens}")


def _token_gap(limits: list[CutLimit]) -> int:
    """Stretches of more tokens than this without a natural boundary get a candidate at each token's end."""
    return max(1, min(16, min((x.max_tokens for x in limits), default=64) // 4))


@lru_cache(maxsize=2)
def _token_lengths(tokenizer: Tokenizer) -> np.ndarray:
    encoding = load(tokenizer)
    lengths = np.zeros(encoding.max_token_value + 1, dtype=np.int64)
    for token, rank in encoding._mergeable_ranks.items():
        lengths[rank] = len(token)
    return lengths


_SPACE, _STOP, _CLOSER, _WIDE_STOP, _WIDE_CLAUSE, _WIDE_LETTER, _BREAK = 1, 2, 4, 8, 16, 32, 64


@lru_cache(maxsize=1)
def _flags() -> np.ndarray:
    """Flags of each character of the basic plane."""
    table = np.zeros(0x10000, dtype=np.uint8)
    for signs, flag in ((_SPACES, _SPACE), (_STOPS, _STOP), (_CLOSERS, _CLOSER), (_WIDE_STOPS, _WIDE_STOP), (_WIDE_CLAUSES, _WIDE_CLAUSE)):
        table[signs] |= flag
    for first, last in ((0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)):
        table[first : last + 1] |= _WIDE_LETTER
    table[[10, 13]] |= _BREAK
    return table


def candidates(
    text: str, tokenizer: Tokenizer, gap: int, tokens: list[int] | None = None, first: bool = True, after: str | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate cuts of ``text``: offsets in characters, tokens up to them, strengths; the last is the end.

    A cut before white space counts as a line's or paragraph's end if that
    white space holds one or more line ends, as a sentence's after a sentence
    sign, else as a word's. Scripts without spaces are cut after their stops and
    clause signs. Only where more than ``gap`` tokens hold none of these, token
    ends between whole characters are candidates.

    A range inside a text is not ``first`` or has text ``after`` it; stretches at
    such an end are not known in full, so their token ends are marked ``_MAYBE``.
    """
    if tokens is None:
        tokens = load(tokenizer).encode_ordinary(text)
    token_ends = np.cumsum(_token_lengths(tokenizer)[np.asarray(tokens, dtype=np.int64)]) if tokens else np.zeros(0, np.int64)
    ascii_only = text.isascii()
    chars = np.frombuffer(text.encode("latin-1"), np.uint8) if ascii_only else np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(chars)
    if ascii_only:
        byte_ends, flags = np.arange(1, n + 1), _flags()[chars]
    else:
        byte_ends = np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF).view(np.int8) + (chars > 0xFFFF).view(np.int8))
        flags = _flags()[np.minimum(chars, 0xFFFF)]
    space = (flags & _SPACE).view(bool)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if n and space[0]:
        edge = edge[1:]
    if n and space[-1] and len(edge):
        edge = np.append(edge, n)
    positions, stops = edge[0::2], edge[1::2]
    if n and space.all():
        positions = stops = edge[:0]
    line_end = np.flatnonzero(flags & _BREAK)
    if len(line_end) and b"\r" in text.encode("utf-8"):
        paired = (chars[line_end] == 13) & (chars[np.minimum(line_end + 1, n - 1)] == 10) & (line_end + 1 < n)
        line_end = line_end[~paired]
    breaks = np.searchsorted(line_end, stops) - np.searchsorted(line_end, positions)
    last, second = flags[positions - 1], flags[np.maximum(positions - 2, 0)]
    sentence = (last & _STOP > 0) | ((last & _CLOSER > 0) & (second & _STOP > 0))
    strength = np.where(breaks >= 2, PARAGRAPH, np.where(breaks == 1, LINE, np.where(sentence, SENTENCE, WORD)))
    if not ascii_only:
        sign = np.flatnonzero(flags[:-1] & (_WIDE_STOP | _WIDE_CLAUSE))
        wide = sign[flags[sign + 1] & _WIDE_LETTER > 0]
        positions = np.append(positions, wide + 1)
        strength = np.append(strength, np.where(flags[wide] & _WIDE_STOP, SENTENCE, WORD))
        order = np.argsort(positions, kind="stable")
        positions, strength = positions[order], strength[order]
    at = np.searchsorted(token_ends, byte_ends[positions - 1]) if len(positions) else np.zeros(0, np.int64)
    true = token_ends[np.minimum(at, len(token_ends) - 1)] == byte_ends[positions - 1] if len(positions) else np.zeros(0, bool)
    positions, strength, counts = positions[true], strength[true], at[true] + 1
    edges = np.concatenate(([0], counts, [len(tokens)]))
    wanted = np.diff(edges) > gap
    open_ends = np.zeros(len(wanted), bool)
    open_ends[0], open_ends[-1] = not first, after is not None or open_ends[-1]
    if len(wanted) == 1:
        open_ends[0] = not first or after is not None
    long = np.flatnonzero(wanted | open_ends)
    if len(long) and len(tokens):
        where = np.searchsorted(byte_ends, token_ends)
        whole = byte_ends[np.minimum(where, n - 1)] == token_ends
        offset = where + 1
        after_space = space[np.minimum(where, n - 1)] & ~np.append(space, True)[np.minimum(offset, n)]
        usable = whole & ~after_space & (offset < n)
        mark = np.full(len(tokens) + 1, TOKEN + 1)
        for i in long:
            mark[edges[i] + 1 : edges[i + 1]] = _MAYBE if open_ends[i] else TOKEN
        extra = np.flatnonzero(usable & (mark[1 : len(tokens) + 1] <= TOKEN))
        positions = np.append(positions, offset[extra])
        counts = np.append(counts, extra + 1)
        strength = np.append(strength, mark[extra + 1])
        order = np.argsort(positions, kind="stable")
        positions, counts, strength = positions[order], counts[order], strength[order]
    end = _END if after is None else _strength_at(text, after)
    return np.append(positions, n), np.append(counts, len(tokens)), np.append(strength, end)


class Cutter:
    """Picks the cuts of one text under one limit from candidates fed in order."""

    def __init__(self, limit: CutLimit, gap: int):
        self.limit, self.gap = limit, gap
        self.position = self.count = self.pieces = 0
        self.rows = np.zeros((3, 0), np.int64)

    def feed(self, offsets: np.ndarray, tokens: np.ndarray, strengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Take further candidates; yields the pieces they settle: number, start, end, tokens."""
        self.rows = np.concatenate((self.rows, np.vstack((offsets, tokens, strengths))), axis=1)
        offsets, tokens, strengths = self.rows
        most, overlap = self.limit.max_tokens, self.limit.overlap_tokens
        low = max(most // 2, overlap + self.gap + 5)
        done = 0
        while len(tokens) > done and tokens[-1] > self.count + most:
            high = int(np.searchsorted(tokens, self.count + most, "right"))
            first = max(int(np.searchsorted(tokens, self.count + low, "left")), done)
            if first >= high:
                first = max(high - 1, done)
            window = strengths[first:high]
            at = first + len(window) - 1 - int(np.argmax(window[::-1]))
            cut = int(offsets[at])
            yield self.pieces, self.position, cut, int(tokens[at]) - self.count
            self.pieces += 1
            back = min(int(np.searchsorted(tokens, tokens[at] - overlap, "right")) - 1, at)
            self.position, self.count = int(offsets[back]), int(tokens[back])
            done = back + 1
        self.rows = self.rows[:, done:]

    def finish(self, length: int, total: int) -> Iterator[tuple[int, int, int, int]]:
        """The last piece; nothing at all if the text never exceeded the limit."""
        if self.pieces:
            yield self.pieces, self.position, length, total - self.count


class Stitcher:
    """Puts the tables of one text's ranges, fed in order, together and cuts it under each limit."""

    def __init__(self, limits: list[CutLimit], gap: int):
        self.cutters, self.gap = [Cutter(limit, gap) for limit in limits], gap
        self.chars = self.tokens = self.edge = 0
        self.waiting = np.zeros((3, 0), np.int64)

    def feed(self, offsets: np.ndarray, counts: np.ndarray, strengths: np.ndarray, chars: int, tokens: int) -> Iterator[tuple]:
        """Take the table of the next range; yields (limit, piece, start, end, tokens)."""
        table = np.concatenate((self.waiting, np.vstack((offsets + self.chars, counts + self.tokens, strengths))), axis=1)
        self.chars, self.tokens = self.chars + chars, self.tokens + tokens
        sure = np.flatnonzero(table[2] != _MAYBE)
        natural = sure[table[2][sure] != TOKEN]
        edges = np.concatenate(([self.edge], table[1][natural]))
        maybe = np.flatnonzero(table[2] == _MAYBE)
        group = np.searchsorted(natural, maybe)
        until = np.append(edges, self.tokens)[group + 1]
        long = until - edges[group] > self.gap
        table[2][maybe[long]] = TOKEN
        undecided = maybe[~long & (group == len(natural))]
        keep = table[2] != _MAYBE
        self.waiting = table[:, undecided]
        self.edge = int(edges[-1])
        ready = table[:, keep]
        for cutter in self.cutters:
            for piece in cutter.feed(*ready):
                yield (cutter.limit.name, *piece)

    def finish(self) -> Iterator[tuple]:
        for cutter in self.cutters:
            for piece in cutter.finish(self.chars, self.tokens):
                yield (cutter.limit.name, *piece)


_PIECE = "limit_name string, doc_id bigint, piece bigint, start_char bigint, end_char bigint, n_tokens bigint, text string"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def _split_whole(limits: list[CutLimit], tokenizer: Tokenizer, gap: int):
    """Arrow function over texts of one range: both steps at once."""
    names = ["limit_name", "doc_id", "piece", "start_char", "end_char", "n_tokens", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    smallest = min(x.max_tokens for x in limits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(tokenizer).encode_ordinary
        out: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = encode(text)
                if len(tokens) <= smallest:
                    continue
                stitcher = Stitcher([x for x in limits if len(tokens) > x.max_tokens], gap)
                pieces = [*stitcher.feed(*candidates(text, tokenizer, gap, tokens), len(text), len(tokens)), *stitcher.finish()]
                out.extend((name, doc, p, a, b, n, text[a:b]) for name, p, a, b, n in pieces)
                if len(out) >= 4000:
                    yield _batch(out, names, types)
                    out = []
        yield _batch(out, names, types)

    return run


def _class(char: str) -> str:
    kind = unicodedata.category(char)[0]
    return "S" if ord(char) in _SPACES else kind if kind in "LN" else "O"


#: Bytes ``[begin, end)`` of a text.
Reader = Callable[[int, int], bytes]


def safe_point(read: Reader, at: int, total: int) -> int:
    """First offset at or after ``at`` that no token of the text straddles; its end ``total`` if there is none.

    Reads as far as it must, twice as much each time. Bytes that are no UTF-8 count as other signs.
    """
    if at <= 0:
        return 0
    step = 128
    while at < total:
        lead = max(0, at - 4)
        data = read(lead, min(total, at + step))
        i, complete = at - lead, lead + len(data) >= total
        while i < len(data) and (complete or i + 4 <= len(data)):
            if data[i] & 0xC0 != 0x80:
                j = i - 1
                while j > max(0, i - 4) and data[j] & 0xC0 == 0x80:
                    j -= 1
                before = data[j:i].decode("utf-8", "replace")[-1]
                if before != "'" and (left := _class(before)) != "S" and left != _class(data[i : i + 4].decode("utf-8", "replace")[0]):
                    return lead + i
            i += 1
        at, step = lead + i, 2 * step
    return total


def _following(read: Reader, at: int, total: int) -> str:
    """What follows ``at``, up to the first character that is no white space or past the second line end."""
    step = 64
    while True:
        text = read(at, min(total, at + step)).decode("utf-8", "replace")
        rest = text.lstrip("".join(map(chr, _SPACES)))
        space = text[: len(text) - len(rest)]
        if len(rest) > 1 or at + step >= total or len(re.findall("\r\n?|\n", space[:-1])) > 1:
            return text
        step *= 2


def _strength_at(before: str, after: str) -> int:
    """Strength of a range's end, by what precedes and follows it."""
    space = after[: len(after) - len(after.lstrip("".join(map(chr, _SPACES))))]
    last = [ord(c) for c in before[-2:]]
    if not space:
        wide = after and ord(after[0]) < 0x10000 and _flags()[ord(after[0])] & _WIDE_LETTER
        return _MAYBE if not wide else SENTENCE if last[-1] in _WIDE_STOPS else WORD if last[-1] in _WIDE_CLAUSES else _MAYBE
    lines = space.replace("\r\n", "\n").replace("\r", "\n").count("\n")
    if lines:
        return PARAGRAPH if lines > 1 else LINE
    return SENTENCE if last[-1] in _STOPS or (last[-1] in _CLOSERS and last[0] in _STOPS) else WORD


_RANGE = "text_no bigint, doc_id bigint, range_no bigint, n_ranges bigint, body string, after string"
_TABLE = "text_no bigint, range_no bigint, n_ranges bigint, chars bigint, tokens bigint, offsets binary, counts binary, strengths binary"
_CUT = "text_no bigint, limit_name string, piece bigint, start_char bigint, end_char bigint, n_tokens bigint, range_no bigint, begin int, length int"


def _slice(range_bytes: int):
    """Arrow function: texts (text_no, doc_id, text) to ranges, each byte copied once."""
    names = ["text_no", "doc_id", "range_no", "n_ranges", "body", "after"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, doc, text in zip(*(batch.column(n).to_pylist() for n in ("text_no", "doc_id", "text"))):
                data = text.encode("utf-8", "replace")
                read = lambda a, b: data[a:b]
                count, start, rows = -(-len(data) // range_bytes), 0, []
                for k in range(count):
                    stop = safe_point(read, max((k + 1) * range_bytes, start), len(data)) if k + 1 < count else len(data)
                    after = _following(read, stop, len(data)) if stop < len(data) else None
                    rows.append((number, doc, k, count, data[start:stop].decode("utf-8", "replace"), after))
                    start = stop
                    if len(rows) * range_bytes >= 1 << 24:
                        yield _batch(rows, names, types)
                        rows = []
                yield _batch(rows, names, types)

    return run


def _table(number: int, range_no: int, n_ranges: int, own: str, after: str | None, tokenizer: Tokenizer, gap: int) -> tuple:
    """A range's candidates as one packed row; the end of the text is its last range's, also if that one is empty."""
    if own:
        offsets, counts, strengths = candidates(own, tokenizer, gap, first=range_no == 0, after=after)
    else:
        offsets = counts = strengths = np.zeros(0, np.int64)
    return (
        number, range_no, n_ranges, len(own), int(counts[-1]) if len(counts) else 0,
        np.diff(offsets, prepend=0).astype("<u4").tobytes(), np.diff(counts, prepend=0).astype("<u4").tobytes(), strengths.astype(np.int8).tobytes(),
    )


_TABLE_NAMES = ["text_no", "range_no", "n_ranges", "chars", "tokens", "offsets", "counts", "strengths"]
_TABLE_TYPES = [pa.int64()] * 5 + [pa.binary()] * 3


def _tables(tokenizer: Tokenizer, gap: int):
    """Arrow function: ranges with their bodies to candidate tables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("text_no", "range_no", "n_ranges", "body", "after")]
            yield _batch([_table(*row, tokenizer, gap) for row in zip(*columns)], _TABLE_NAMES, _TABLE_TYPES)

    return run


def _stitch(limits: list[CutLimit], gap: int):
    """Arrow function over tables sorted by (text_no, range_no): prefix sums, then cuts, as one row per range a piece lies in."""
    names = ["text_no", "limit_name", "piece", "start_char", "end_char", "n_tokens", "range_no", "begin", "length"]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int32()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stitcher, starts = None, None, []
        for batch in batches:
            rows: list[tuple] = []
            for number, range_no, n_ranges, chars, tokens, offsets, counts, strengths in zip(*(batch.column(n).to_pylist() for n in _TABLE_NAMES)):
                if number != current:
                    current, stitcher, starts = number, Stitcher(limits, gap), []
                starts.append(stitcher.chars)
                packed = (np.cumsum(np.frombuffer(x, "<u4").astype(np.int64)) for x in (offsets, counts))
                found = list(stitcher.feed(*packed, np.frombuffer(strengths, np.int8), chars, tokens))
                if range_no + 1 == n_ranges:
                    found += stitcher.finish()
                for name, piece, a, b, n in found:
                    for k in range(bisect.bisect_right(starts, a) - 1, bisect.bisect_left(starts, b)):
                        upto = starts[k + 1] if k + 1 < len(starts) else stitcher.chars
                        begin, end = max(a, starts[k]), min(b, upto)
                        if end > begin:
                            rows.append((current, name, piece, a, b, n, k, begin - starts[k], end - begin))
            yield _batch(rows, names, types)

    return run


def _cuts(tables: DataFrame, limits: list[CutLimit], gap: int) -> DataFrame:
    laid = tables.repartition("text_no").sortWithinPartitions("text_no", "range_no")
    return laid.mapInArrow(_stitch(limits, gap), _CUT)


def _whole(fragments: DataFrame, key: str) -> DataFrame:
    """Pieces put together from their fragments (``key`` names the text in the result)."""
    whole = fragments.groupBy("text_no", key, "limit_name", "piece", "start_char", "end_char", "n_tokens").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "fragment"))), lambda x: x["fragment"]), "").alias("text")
    )
    return whole.select("limit_name", key, "piece", "start_char", "end_char", "n_tokens", "text")


def split_texts(documents: DataFrame, limits: list[CutLimit], tokenizer: Tokenizer = Tokenizer(), range_bytes: int = 32_768) -> DataFrame:
    """The pieces of every text of ``documents`` (doc_id, text) that exceeds a limit, for each limit.

    Result: ``limit_name, doc_id, piece, start_char, end_char, n_tokens, text``.
    Pieces are slices of the text, in order and without a gap; each has at most
    ``max_tokens`` tokens, measured by itself. A cut is made at the strongest
    boundary in the second half of the room (paragraph, line, sentence, word,
    token), the last of equal ones. The next piece starts at the last candidate
    that repeats at least ``overlap_tokens`` tokens of the piece before.

    Texts that are null or within the limit have no pieces; repeated rows are
    texts of their own; a null id stays null. The size of the ranges is a
    matter of speed only.
    """
    spark = documents.sparkSession
    if not limits:
        return spark.createDataFrame([], _PIECE)
    gap = _token_gap(limits)
    _checked(limits, gap)
    size = F.octet_length("text")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(size > min(x.max_tokens for x in limits))
    short = texts.where(size <= range_bytes).mapInArrow(_split_whole(limits, tokenizer, gap), _PIECE)
    long = texts.where(size > range_bytes).withColumn("text_no", F.monotonically_increasing_id())
    ranges, _ = materialize(long.mapInArrow(_slice(range_bytes), _RANGE).repartition("text_no", "range_no"), "text-ranges")
    cuts = _cuts(ranges.mapInArrow(_tables(tokenizer, gap), _TABLE), limits, gap)
    held = cuts.join(ranges.select("text_no", "doc_id", "range_no", "body"), ["text_no", "range_no"])
    return short.unionByName(_whole(held.withColumn("fragment", F.substr("body", F.col("begin") + 1, F.col("length"))), "doc_id"))


def _open(path: str):
    """A file of any file system pyarrow knows, for reading by offset."""
    system, place = arrow_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return system.open_input_file(place)


def _file_tables(range_bytes: int, tokenizer: Tokenizer, gap: int):
    """Arrow function: (text_no, path, size, range_no, n_ranges) to tables with the range's place in its file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, path, size, range_no, n_ranges in zip(*(batch.column(n).to_pylist() for n in ("text_no", "path", "size", "range_no", "n_ranges"))):
                with _open(path) as file:
                    read = lambda a, b: file.read_at(b - a, a)
                    begin = safe_point(read, range_no * range_bytes, size)
                    end = safe_point(read, (range_no + 1) * range_bytes, size) if range_no + 1 < n_ranges else size
                    own = read(begin, end).decode("utf-8", "replace") if end > begin else ""
                    after = _following(read, end, size) if end < size else None
                rows.append((*_table(number, range_no, n_ranges, own, after, tokenizer, gap), path, begin, max(end - begin, 0)))
                if len(rows) >= 64:
                    yield _batch(rows, [*_TABLE_NAMES, "path", "at", "size"], [*_TABLE_TYPES, pa.string(), pa.int64(), pa.int64()])
                    rows = []
            yield _batch(rows, [*_TABLE_NAMES, "path", "at", "size"], [*_TABLE_TYPES, pa.string(), pa.int64(), pa.int64()])

    return run


def _file_fragments(columns: list[str], types: list[pa.DataType]):
    """Arrow function: cuts with the place of their range to the text of each fragment; a range is read once for neighbours in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, body = None, ""
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if held != (row["path"], row["at"]):
                    held = row["path"], row["at"]
                    with _open(row["path"]) as file:
                        body = file.read_at(row["size"], row["at"]).decode("utf-8", "replace")
                rows.append((*(row[c] for c in columns[:-1]), body[row["begin"] : row["begin"] + row["length"]]))
            yield _batch(rows, columns, types)

    return run


def split_files(
    spark: SparkSession, paths: list[str], limits: list[CutLimit], tokenizer: Tokenizer = Tokenizer(), range_bytes: int = 1 << 20, keep: Column | None = None
) -> DataFrame:
    """``split_texts`` of files (paths, folders or patterns), each read by byte ranges: ``path`` takes the place of ``doc_id``.

    Files are listed by Spark, with ``keep`` as a condition on ``path`` and
    ``length``; workers read them through pyarrow's file systems (local, HDFS,
    S3, GCS, Azure). Bytes that are no UTF-8 are replaced. Empty files have no
    pieces.
    """
    if not limits:
        return spark.createDataFrame([], _PIECE.replace("doc_id bigint", "path string"))
    gap = _token_gap(limits)
    _checked(limits, gap)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", F.col("length").alias("size"))
    if keep is not None:
        listed = listed.withColumnRenamed("size", "length").where(keep).withColumnRenamed("length", "size")
    listed, _ = materialize(listed.where(F.col("size") > min(x.max_tokens for x in limits)).withColumn("text_no", F.monotonically_increasing_id()), "files-listed")
    n_ranges = F.ceil(F.col("size") / range_bytes).cast("long")
    spread = listed.withColumn("n_ranges", n_ranges).withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), n_ranges - 1)))
    tables = spread.repartition(4 * task_count(spark), "text_no", "range_no").mapInArrow(_file_tables(range_bytes, tokenizer, gap), _TABLE + ", path string, at bigint, size bigint")
    tables, _ = materialize(tables, "file-tables")
    places = tables.select("text_no", "range_no", "path", "at", "size")
    held = _cuts(tables.select(*_TABLE_NAMES), limits, gap).join(places, ["text_no", "range_no"]).sortWithinPartitions("text_no", "range_no")
    columns = ["text_no", "path", "limit_name", "piece", "start_char", "end_char", "n_tokens", "range_no", "fragment"]
    types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.string()]
    shape = "text_no bigint, path string, limit_name string, piece bigint, start_char bigint, end_char bigint, n_tokens bigint, range_no bigint, fragment string"
    return _whole(held.mapInArrow(_file_fragments(columns, types), shape), "path")
