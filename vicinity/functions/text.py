"""Text cleaning that the JVM has no function for."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def unescape_twice(text: pd.Series) -> pd.Series:
    """Character references decoded, and decoded again, then stripped; null stays null."""
    return text.map(lambda x: None if x is None else html.unescape(html.unescape(x)).strip())


def token_rows(vocabulary: str, length: int = 77, truncate: bool = False):
    """A function of a text column: ids of a byte-pair vocabulary between its start and end ids, padded with 0 to ``length``.

    ``vocabulary`` is the JSON text of the tokenizer, read on the driver, so workers need no file. Texts are cleaned first. One
    that is too long is an error, or cut with its last id the end if ``truncate``.
    """

    @F.pandas_udf("array<int>")
    def encode(text: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary)
        start, end = t.token_to_id("<|startoftext|>"), t.token_to_id("<|endoftext|>")
        cleaned = [" ".join(html.unescape(html.unescape(x or "")).split()).lower() for x in text]
        out = []
        for one in t.encode_batch(cleaned, add_special_tokens=False):
            ids = [start, *one.ids, end]
            if len(ids) > length:
                if not truncate:
                    raise ValueError(f"a text has {len(ids)} ids; {length} is the most")
                ids = [*ids[: length - 1], end]
            out.append(ids + [0] * (length - len(ids)))
        return pd.Series(out)

    return encode
