"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary is; another path may be given to every function.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def vocabulary(path: str = VOCABULARY) -> str:
    """A path as it is, or the file of that name among the installed public tokenizers if the path isn't there."""
    import os

    if os.path.exists(path):
        return path
    import public_tokenizers

    return str(public_tokenizers.path(os.path.basename(path)))


@lru_cache(maxsize=4)
def encoder(path: str):
    """One encoder per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text))


def token_count(text: str, path: str = VOCABULARY) -> Column:
    """Tokens of a text column; null has none."""

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for b in batches:
            yield pd.Series([0 if t is None else len(e.encode_ordinary(t)) for t in b], dtype="int64")

    return counted(F.col(text))
