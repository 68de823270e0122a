"""Mixing sources to target weights by distributed prefix sums.

Every text gets a hash-random key. Within its source it is laid out in ranges
of that key (a key is uniform, so equal ranges hold equal numbers of texts and
no sampling is needed); token sums of the ranges, then running sums inside each
range, give every text its exact place in its source. A source is cut where the
running sum reaches its budget. A budget above the source's size takes whole
epochs first and cuts the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import materialize
from .tokens import Tokenizer, token_count


def source_key(source: str):
    """A source's name trimmed, in lower case, with ``_`` for ``-``."""
    return F.translate(F.lower(F.trim(F.col(source))), "-", "_")


def _budgets(sizes: dict[str, int], targets: list, total: int | None) -> list[dict]:
    """Budget of each target source; shares are scaled to sum 1 over the sources that have any text."""
    present = [t for t in targets if sizes.get(t["source"], 0) > 0 and t["target_share"] > 0]
    weight = sum(t["target_share"] for t in present)
    reach = [sizes[t["source"]] * t["max_repeats"] / (t["target_share"] / weight) for t in present]
    goal = total if total is not None else int(min(reach)) if reach else 0
    plan = []
    for t in targets:
        own = sizes.get(t["source"], 0)
        share = t["target_share"] / weight if t in present else 0.0
        wanted = math.floor(share * goal + 1e-9)
        plan.append({**t, "size": own, "wanted": wanted, "budget": min(wanted, own * t["max_repeats"])})
    return plan


def mix(
    sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, range_rows: int = 50_000
) -> tuple[DataFrame, list[dict]]:
    """A mixture of ``sizes`` (doc_id, source, n_tokens, text_key) in the shares of ``targets``; and its plan.

    ``targets`` has source, target_share and max_repeats (null: once). Without
    ``total_tokens`` the mixture is the largest that keeps every share. A source
    without any text cannot contribute: it is reported with 0 and the other
    shares are scaled up. With a total that a source cannot reach in
    ``max_repeats`` epochs, that source falls short and is reported so.

    A text is the same text under any id (equal ``text_key``); it belongs to
    the source and id that come first and is used at most ``max_repeats`` times.
    Rows with a null source, a source outside the targets, or no tokens take no
    part. Empty tables give no rows.

    Result: ``source, doc_id, epoch, n_tokens, mix_key``; ``n_tokens`` is what
    the mixture takes of the text, less than its size only for the one text
    that a source's budget ends in. Ordering by ``mix_key`` interleaves sources.
    """
    wanted: dict[str, dict] = {}
    for r in targets.select("source", "target_share", "max_repeats").collect():
        if r["source"] is not None and r["source"] not in wanted:
            wanted[r["source"]] = {"source": r["source"], "target_share": max(r["target_share"] or 0.0, 0.0), "max_repeats": 1 if r["max_repeats"] is None else max(r["max_repeats"], 0)}
    rows = sizes.where(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0))
    texts = rows.groupBy("text_key").agg(F.min(F.struct("source", "doc_id", "n_tokens")).alias("t")).select("t.*")
    texts, _ = materialize(texts, "mix-texts")
    counted = texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    plan = _budgets({r["source"]: r["tokens"] for r in counted}, list(wanted.values()), total_tokens)
    bits = max([0, *(math.ceil(math.log2(max(1, r["n"] / range_rows))) for r in counted)])

    def of_source(values: dict[str, int]):
        pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("long"))]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0)) if pairs else F.lit(0).cast("long")

    full = {p["source"]: p["budget"] // p["size"] if p["size"] else 0 for p in plan}
    rest = {p["source"]: p["budget"] - full[p["source"]] * p["size"] for p in plan}
    epochs = F.when(of_source(full) > 0, F.sequence(F.lit(0).cast("long"), of_source(full) - 1))
    whole = texts.select("source", "doc_id", "n_tokens", F.explode(epochs).alias("epoch"))
    keyed = texts.withColumn("key", F.xxhash64(F.lit(seed), of_source(full), "doc_id", "n_tokens"))
    keyed = keyed.withColumn("range", F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long"))
    ranges = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("in_range"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("in_range").over(upto), F.lit(0))).drop("in_range")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(ranges, ["source", "range"])
    left = of_source(rest) - (F.col("base") + F.col("before"))
    cut = placed.where(left > 0).select(
        "source", "doc_id", F.least(F.col("n_tokens"), left).cast("long").alias("n_tokens"), of_source(full).alias("epoch")
    )
    mixed = whole.unionByName(cut)
    key = F.xxhash64(F.lit(seed), F.lit("order"), "epoch", "doc_id")
    return mixed.select("source", "doc_id", "epoch", "n_tokens", key.alias("mix_key")), plan


def document_sizes(documents: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """``doc_id, source, n_tokens, text_key`` of documents; the key is a 256-bit digest of the text."""
    return documents.where(F.col("text").isNotNull()).select(
        "doc_id",
        source_key("source").alias("source"),
        token_count(F.col("text"), tokenizer).alias("n_tokens"),
        F.unhex(F.sha2("text", 256)).alias("text_key"),
    )


def share_report(mixed: DataFrame, plan: list[dict]) -> DataFrame:
    """Per target source: wanted share and tokens, tokens and share reached, epochs, and whether it fell short."""
    spark = mixed.sparkSession
    shape = "source string, target_share double, max_repeats bigint, source_tokens bigint, wanted_tokens bigint"
    wanted = spark.createDataFrame(
        [(p["source"], float(p["target_share"]), p["max_repeats"], p["size"], p["wanted"]) for p in plan], shape
    )
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("epoch") + 1).alias("epochs"))
    both = wanted.join(reached, "source", "left").fillna(0, ["tokens", "epochs"])
    share = F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    return both.select(
        *wanted.columns, "tokens", "epochs", F.round(share, 6).alias("actual_share"), (F.col("tokens") < F.col("wanted_tokens")).alias("is_short")
    )
