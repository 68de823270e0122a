"""Text sizes in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import Column, functions as F

# Fixed value: the public pre-tokenization pattern that the byte-level vocabulary was made with.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE vocabulary (base64 token and rank per line) and its pre-tokenization pattern."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = BYTE_BPE_PATTERN


@lru_cache(maxsize=4)
def load(tokenizer: Tokenizer) -> tiktoken.Encoding:
    with open(tokenizer.path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=tokenizer.pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, tokenizer: Tokenizer = Tokenizer()) -> Column:
    """Number of tokens of the whole text; 0 for an empty one, null for null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load(tokenizer).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(text)
