"""Token counts by a public byte-level BPE. The vocabulary file is a parameter and is read on the executors."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Text that gives context only: a front matter block, and what a user says, up to the next blank line.
_context = re.compile(r"\A---\n.*?\n---(?:\n|\Z)|^(?:User|Human|Prompt):.*?(?=\n[ \t]*\n|\Z)", re.S | re.M)


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counts(text: str, enc) -> tuple[int, int]:
    """All tokens of a text, and those of them that bear loss."""
    total = len(enc.encode_ordinary(text))
    context = sum(len(enc.encode_ordinary(m[0])) for m in _context.finditer(text))
    return total, max(0, total - context)


def token_counts(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, *keep, tokens, loss_tokens): null text has none; rows of one id fall together (the longest counts)."""

    @F.pandas_udf("struct<tokens:int,loss_tokens:int>")
    def measure(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(vocabulary)
        return pd.DataFrame([counts(t, enc) if t else (0, 0) for t in texts], columns=["tokens", "loss_tokens"])

    rows = documents.where("doc_id is not null").select("doc_id", *keep, measure("text").alias("m")).select("doc_id", *keep, "m.*")
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*keep, "tokens", "loss_tokens"), F.struct("tokens", "loss_tokens", *keep)).alias("r")).select("doc_id", "r.*")
