"""Sizes of texts in tokens of a public tokenizer, whose file is named by its path and never copied."""

from __future__ import annotations

import base64
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.runtime import spread

#: A byte-level vocabulary as ranks; the file has to be at this place on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this family cut a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of blanks from which the tokenizer's own splitting would run out of stack.
_LONG_BLANK = re.compile(r"\s{5000,}")


@cache
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("codeloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of one text. Very long runs of blanks are one word each, as the pattern has it, and are encoded as such."""
    if not text:
        return 0
    known = encoding(path)
    total, at = 0, 0
    for run in _LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1  # the last blank goes with the next word
        total += len(known.encode_ordinary(text[at : run.start()])) + len(known._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(known.encode_ordinary(text[at:]))


#: Counts of texts that a worker keeps, by digest, so that copies of a text are counted once by each.
MEMO = 200_000


def n_tokens(text: Column, path: str = VOCABULARY, digest: Column | None = None) -> Column:
    """Tokens of a text; 0 for null and empty ones. Texts are counted whole, copies of one digest once per worker."""

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series, digests: pd.Series) -> pd.Series:
        known = _memo(path)
        out = []
        for text, key in zip(texts, digests):
            n = known.get(key)
            if n is None:
                n = count(text, path)
                if len(known) >= MEMO:
                    known.clear()
                known[key] = n
            out.append(n)
        return pd.Series(out, dtype="int64")

    held = F.coalesce(text, F.lit(""))
    return counted(held, F.sha2(held, 256) if digest is None else digest)


@cache
def _memo(path: str) -> dict[str, int]:
    return {}


def sizes(documents: DataFrame, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """doc_id, source and tokens of each document, with the digest of its text."""
    rows = spread(documents.select("doc_id", "source", text)).withColumn("digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return rows.select("doc_id", "source", n_tokens(F.col(text), path, F.col("digest")).alias("tokens"), "digest")
