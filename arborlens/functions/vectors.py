"""Vectors as bytes and arrays, pooling, and time stamps as text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def unpack_floats(packed: Column | str) -> Column:
    """Little-endian 32-bit floats of a binary column; null for null or a length that is no multiple of four."""

    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())

    return unpack(packed)


def pack_floats(vectors: Column | str) -> Column:
    """The reverse of ``unpack_floats``."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(vectors)


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the token vectors (array of arrays) whose mask is not 0; zeros if there is none.

    Works per dimension of the first token's vector.
    """
    kept = F.filter(F.arrays_zip(states.alias("state"), mask.alias("weight")), lambda x: x["weight"] != 0)
    count = F.size(kept)

    def mean(dimension: Column) -> Column:
        total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.get(x["state"], dimension).cast("double"))
        return F.when(count > 0, total / count).otherwise(0.0)

    width = F.size(F.get(states, F.lit(0)))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), mean)).otherwise(F.array().cast("array<double>"))


def unit_length(vector: Column) -> Column:
    """The vector divided by its length; itself if that is 0."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def utc_text(seconds: Column) -> Column:
    """Epoch seconds as ``2024-01-31T12:00:00Z``."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def known_value(value: Column, allowed: list[str], what: str) -> Column:
    """The value if it is null or one of ``allowed``; otherwise an error when the result is computed."""
    return F.when(value.isNull() | value.isin(allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)))
