"""References to records that do not exist.

References are composite keys, some columns of which may be null. They are
grouped by null mask; each mask is checked by an anti-join on its non-null
columns, under the declared match semantics:

* ``simple``: a reference with any null column is not checked;
* ``full``: all null is not checked, some null is always an orphan;
* ``partial``: the non-null columns must agree with some parent row;
* ``exact``: a null in the reference only meets a null in the parent.

Keys are reduced to distinct ones, with their counts, before the anti-join, so
a hot key costs one row there. On the way back to the referring rows, keys that
hold more than ``1 / hot_fraction`` of them are matched from a broadcast list
(at most ``1 / hot_fraction`` entries by construction) and never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize

MATCHES = ("simple", "full", "partial", "exact")


def _mask(columns: list[str]):
    return reduce(lambda a, b: a + b, [F.isnull(c).cast("int") * F.lit(2**i) for i, c in enumerate(columns)])


def count_keys(references: DataFrame, key: list[str]) -> DataFrame:
    """Distinct key combinations with their number of rows ``n_rows`` (combined before the shuffle)."""
    return references.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))


def orphan_keys(counted: DataFrame, parents: DataFrame, key: list[str], match: str = "simple") -> DataFrame:
    """Of ``count_keys``, those without a parent: the key columns, ``n_rows`` and ``mask``.

    Bit i of ``mask`` says that key column i is null. A key whose columns are
    all null refers to nothing. Parents may repeat; their other columns are
    ignored. Empty references give no rows, empty parents make every checked
    key an orphan.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    everything = 2 ** len(key) - 1
    masked = counted.withColumn("mask", _mask(key))
    known = parents.select(*key)
    found = []
    for mask in range(everything):
        if mask and match == "simple":
            continue
        own = masked.where(F.col("mask") == mask)
        if mask and match == "full":
            found.append(own)
            continue
        present = [c for i, c in enumerate(key) if not mask >> i & 1]
        side = known.where(_mask(key) == mask) if match == "exact" else known
        side = side.select(*[F.col(c).alias(f"parent_{c}") for c in present]).dropna()
        on = reduce(lambda a, b: a & b, [own[c] == side[f"parent_{c}"] for c in present])
        found.append(own.join(side, on, "left_anti"))
    return reduce(DataFrame.unionByName, found)


def orphan_rows(
    references: DataFrame,
    parents: DataFrame,
    key: list[str],
    keep: list[str],
    match: str = "simple",
    hot_fraction: int = 1000,
) -> DataFrame:
    """The referring rows (columns ``keep``) whose key has no parent, once per referring row.

    Repeated referring rows come out as often as they go in; nulls in ``keep``
    pass through.
    """
    names = [f"ref_{i}" for i in range(len(key))]
    rows = references.select(*keep, *[F.col(c).alias(n) for c, n in zip(key, names)])
    known = parents.select(*[F.col(c).alias(n) for c, n in zip(key, names)])
    counted, _ = materialize(count_keys(rows, names), "reference-keys")
    total = counted.agg(F.sum("n_rows")).first()[0] or 0
    floor = max(1, total // hot_fraction)
    missing, _ = materialize(orphan_keys(counted, known, names, match).select(*names, "n_rows"), "orphan-keys")
    busy = counted.where(F.col("n_rows") > floor)
    hot, cold = missing.where(F.col("n_rows") > floor), missing.where(F.col("n_rows") <= floor)

    def on(side: str):
        return reduce(lambda a, b: a & b, [F.col(f"r.{n}").eqNullSafe(F.col(f"{side}.{n}")) for n in names])

    from_hot = rows.alias("r").join(F.broadcast(hot).alias("h"), on("h"), "left_semi")
    light = rows.alias("r").join(F.broadcast(busy).alias("b"), on("b"), "left_anti")
    from_cold = light.alias("r").join(cold.alias("c"), on("c"), "left_semi")
    return from_hot.unionByName(from_cold).select(*keep)
