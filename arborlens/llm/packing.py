"""Filling fixed-capacity containers: bounded-space online best-fit, sharded.

Items are hashed to shards of bounded size. A shard is one pass in item order
with at most ``open_bins`` open containers, kept in a bitset with one bit per
amount of free space: the lowest set bit at or above an item's size is the
best fit. When none fits and all bins are open, the fullest is closed. What is
still open when a shard ends is not given up: these part-filled bins are items
of the next level, packed in the same way into far fewer shards, until one
shard remains per capacity. So the space wasted by sharding does not grow with
the number of shards.

Memory is constant per task, nothing is collected, and an item order fixed by
the sort makes a repeated task give the same containers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .tokens import Tokenizer, token_count

_PLACED = "limit_name string, doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, bin string, base bigint, is_open boolean"


class OpenBins:
    """Best-fit over at most ``limit`` open bins of one capacity; bins are numbered from 0."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.opened = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """Put an item of ``size <= capacity``; returns its bin and its offset there."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
            if size < self.capacity and self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free

    def remaining(self) -> Iterator[tuple[int, int]]:
        """The open bins with their fill."""
        for free, bins in self.by_free.items():
            for number in bins:
                yield number, self.capacity - free


def _pack_shards(level: int, open_bins: int):
    """Arrow function over rows sorted by (limit_name, shard, ...): places items, then lists what stays open."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["limit_name", "doc_id", "piece", "start_token", "n_tokens", "bin", "base", "is_open"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        current, bins, out = None, None, []

        def emit():
            columns = list(zip(*out)) if out else [[]] * len(names)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        def label(number: int) -> str:
            return f"{current[0]}/{level}.{current[1]}.{number}"

        def close():
            if bins is not None:
                out.extend((current[0], None, None, None, fill, label(n), None, True) for n, fill in bins.remaining())

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("limit_name", "shard", "max_tokens", "doc_id", "piece", "start_token", "n_tokens", "item")]
            for limit, shard, capacity, doc, piece, start, size, item in zip(*columns):
                if current != (limit, shard):
                    close()
                    current, bins = (limit, shard), OpenBins(capacity, open_bins)
                number, offset = bins.place(size)
                if level:
                    out.append((item, None, None, None, size, label(number), offset, False))
                else:
                    out.append((limit, doc, piece, start, size, label(number), offset, False))
            if out:
                yield emit()
        close()
        if out:
            yield emit()

    return run


def _run_level(items: DataFrame, level: int, shards: int, open_bins: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    laid = items.repartition("limit_name", "shard").sortWithinPartitions("limit_name", "shard", *order)
    placed = laid.mapInArrow(_pack_shards(level, open_bins), _PLACED)
    done, _ = materialize(placed, f"packed-{level}")
    return done.where(~F.col("is_open")), done.where("is_open")


def pack(
    sizes: DataFrame, limits: DataFrame, open_bins: int = 64, shard_items: int = 50_000, shard_tokens: int = 20_000_000
) -> DataFrame:
    """Assign every item of ``sizes`` (doc_id, n_tokens) to containers of each capacity in ``limits``.

    ``limits`` has limit_name and max_tokens; rows whose capacity is null or
    below 1 are ignored. An item above the capacity is split into pieces of just
    the capacity and a rest; any other is kept whole. Items with a null size are
    no items; a size of 0 takes no space but gets its row. Repeated rows are
    items of their own. No items give no rows.

    Result: ``limit_name, container_id, doc_id, piece, start_token, n_tokens,
    container_offset``; the tokens of a piece are ``[start_token, start_token +
    n_tokens)`` of its text.
    """
    sizes = sizes.select("doc_id", F.col("n_tokens").cast("long").alias("size")).where(F.col("size").isNotNull())
    sizes, _ = materialize(sizes, "sizes")
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()
    shards = max(1, math.ceil(total["n"] / shard_items), math.ceil(total["t"] / shard_tokens))
    capacities = limits.select("limit_name", F.col("max_tokens").cast("long").alias("max_tokens")).where(F.col("max_tokens") >= 1)
    pairs = sizes.withColumn("limit", F.explode(F.array(*[F.struct(F.lit(r["limit_name"]).alias("limit_name"), F.lit(r["max_tokens"]).cast("long").alias("max_tokens")) for r in capacities.collect()] or [F.lit(None).cast("struct<limit_name:string,max_tokens:bigint>")])))
    pairs = pairs.where(F.col("limit").isNotNull()).select("doc_id", "size", "limit.*")
    last = F.greatest(F.ceil(F.col("size") / F.col("max_tokens")), F.lit(1)) - 1
    pieces = pairs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("piece") * F.col("max_tokens")
    items = pieces.select(
        "limit_name",
        "max_tokens",
        F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)).alias("shard"),
        "doc_id",
        "piece",
        start.alias("start_token"),
        F.least(F.col("size") - start, F.col("max_tokens")).alias("n_tokens"),
        F.lit(None).cast("string").alias("item"),
    )
    rows, rest = _run_level(items, 0, shards, open_bins, ["doc_id", "piece", "n_tokens"])
    level = 0
    while shards > 1:
        level += 1
        n_open = rest.count()
        shards = min(shards - 1, max(1, math.ceil(n_open / shard_items)))
        again = rest.select("limit_name", F.col("bin").alias("item"), "n_tokens").join(capacities, "limit_name")
        again = again.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
        again = again.withColumns({c: F.lit(None).cast("long") for c in ("doc_id", "piece", "start_token")})
        moved, rest = _run_level(again, level, shards, open_bins, ["item"])
        moved = moved.select(F.col("limit_name").alias("old_bin"), F.col("bin").alias("new_bin"), F.col("base").alias("shift"))
        rows = rows.join(moved, F.col("bin") == F.col("old_bin"), "left").select(
            "limit_name", "doc_id", "piece", "start_token", "n_tokens",
            F.coalesce("new_bin", "bin").alias("bin"),
            (F.col("base") + F.coalesce("shift", F.lit(0))).alias("base"),
        )
    return rows.select(
        "limit_name", F.col("bin").alias("container_id"), "doc_id", "piece", "start_token", "n_tokens", F.col("base").alias("container_offset")
    )


def pack_texts(documents: DataFrame, limits: DataFrame, tokenizer: Tokenizer = Tokenizer(), **options: int) -> DataFrame:
    """``pack`` of documents (doc_id, text) measured in tokens; null texts are no items, blank ones are."""
    return pack(documents.select("doc_id", token_count(F.col("text"), tokenizer).alias("n_tokens")), limits, **options)


def fill_report(assigned: DataFrame, limits: DataFrame) -> DataFrame:
    """Per capacity: containers, pieces, tokens and the share of all space that is used (rounded to 6 places)."""
    by = assigned.groupBy("limit_name").agg(
        F.count_distinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")
    )
    used = F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens"))
    return by.join(limits.select("limit_name", "max_tokens"), "limit_name").select(
        "limit_name", "max_tokens", "n_containers", "n_pieces", "n_tokens", F.round(used, 6).alias("fill")
    )
