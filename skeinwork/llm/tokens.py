"""Sizes of texts in tokens of a public tokenizer, whose file is named by a parameter and never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public byte-level vocabulary splits text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _sizes(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens: of a file of ranks (.tiktoken) or of a whole tokenizer (.json)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e) for at in range(0, len(texts), 256) for e in tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]


def token_counts(docs: DataFrame, doc_id: str, text: str, *others: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, others, n_tokens) of every row; whole texts, each distinct one of a batch once. Null has 0 tokens."""

    def run(values: pd.Series) -> pd.Series:
        distinct = [v for v in values.unique() if v is not None and v == v]
        sizes = dict(zip(distinct, _sizes(tokenizer)(distinct), strict=True))
        return values.map(sizes).fillna(0).astype("int64")

    return docs.select(F.col(doc_id), *others, F.pandas_udf(run, "long")(text).alias("n_tokens"))
