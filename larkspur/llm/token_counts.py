"""Operator 3, token counts: rank-synchronous array merging.

Texts are cut into pre-tokens for a whole batch at once; the distinct ones are held as one ragged
numpy array, every sequence applies its lowest-ranked pair in each round, and what survives is counted
(see `pretokens.MergeTable.merge`). No shuffle: each row is judged where it was read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .cluster import mapped_text


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, text_col: str = "text", keep: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); one row per input row.

    Null and empty texts have 0 bytes and 0 tokens. Texts are never cut short; repeated rows and null
    ids stay as they are; an empty table gives an empty one. Input columns named like an output column
    are replaced. tokenizer_path: a file of the tokenizers library (BPE); added tokens inside a text
    count as one token each, as in that library's default.
    """

    def work():
        from .pretokens import encoder

        counter = encoder(tokenizer_path)

        def fn(texts):
            tokens = counter.counts(texts)
            sizes = np.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], np.int64)
            return None, [sizes, tokens, tokens > limit]

        return fn

    return mapped_text(docs, text_col, "n_bytes long, n_tokens long, over_limit boolean", work, keep_text, keep)
