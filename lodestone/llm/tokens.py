"""Token counts with a public tokenizer whose rank file is given by path."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rank file used unless another path is given; it isn't part of this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """One encoder per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text as bigint; 0 for null and empty texts. Strings of special tokens count as ordinary text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)
