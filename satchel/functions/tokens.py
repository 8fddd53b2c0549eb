"""Token counts: the byte estimate, or an exact count with a supplied vocabulary."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Published pre-tokenizer patterns of the two public encodings.
PRETOKENIZERS = {
    "cl100k_base": (
        r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+|"
        r" ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
    ),
    "o200k_base": "|".join((
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    )),
}


@functools.lru_cache(maxsize=4)
def _encoding(name: str, vocab_path: str):
    """One tokenizer per Python worker; the vocabulary lists ``base64 rank`` lines."""
    import tiktoken

    ranks = {}
    with open(vocab_path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(
        name=name, pat_str=PRETOKENIZERS[name], mergeable_ranks=ranks, special_tokens={})


def exact_tokens(text: Column, encoding: str, vocab_path: str) -> Column:
    """Count tokens of whole bodies; ``vocab_path`` must be readable by every executor."""
    if encoding not in PRETOKENIZERS:
        raise ValueError(f"Unknown token encoding: {encoding}")

    @F.pandas_udf(T.LongType())
    def count(bodies: pd.Series) -> pd.Series:
        coder = _encoding(encoding, vocab_path)
        return bodies.map(lambda b: len(coder.encode_ordinary(b)) if b else 0).astype("int64")

    return count(text)
