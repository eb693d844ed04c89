"""Token counts of texts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File of ranks used where none is named; looked up beside the installed ``public_tokenizers``.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens of the whole text; null for a null text, 0 for an empty one."""
    where = path or vocabulary_path()

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(where).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return counted(text)


def sized_documents(df: DataFrame, *more: str, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, *more)`` of the documents with an id and a text."""
    rows = df.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", *more, "text")
    return rows.withColumn("n_tokens", count_tokens(F.col("text"), path)).drop("text")
