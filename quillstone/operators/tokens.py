"""Exact token counts by a tokenizer's file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def bpe_count(path: str) -> Callable:
    """A function of a text column: tokens of each whole text, 0 for null. ``path`` is a file of the ``tokenizers`` library that
    every executor can read; it is loaded once per worker task and special strings in a text count as ordinary text."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        for s in texts:
            yield pd.Series([len(model.encode(x, add_special_tokens=False).ids) if x else 0 for x in s], dtype="int64")

    return count
