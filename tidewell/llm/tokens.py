"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from tidewell.session import spread

#: Default vocabulary file; any rank file of the same kind will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(4)
def encoder(path: str):
    """The byte-level BPE of a rank file; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    try:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    except ImportError:
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("rank-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """documents -> (key, *keep, n_tokens): whole texts measured; null and empty texts have 0 tokens."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in documents.select(key, *keep).schema] + ["n_tokens long"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            out = b[[key, *keep]].copy()
            out["n_tokens"] = [len(x) for x in enc.encode_ordinary_batch(b["text"].fillna("").tolist(), num_threads=1)]
            yield out

    return spread(documents.select(*dict.fromkeys([key, *keep, "text"]))).mapInPandas(measure, schema)
