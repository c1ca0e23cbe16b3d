"""Text sizes in tokens of a public byte-level BPE vocabulary.

Counting is exact. Each pre-token is encoded on its own, and a pre-token never runs across a
space that a non-blank follows, so a text's count is the sum over its pieces between such
spaces. Pieces repeat very often in natural text, so their counts are remembered, which makes
counting several times faster than encoding.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file lies on every machine; a parameter of all that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that cuts a text into pre-tokens for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Remembered pieces per worker; when full, the memory starts anew (results don't depend on it).
REMEMBERED = 500_000
#: Longer pieces are rare and not worth remembering.
LONGEST_REMEMBERED = 40

_IRREGULAR = re.compile(r" (?:\s|\Z)")
_counters: dict[str, Callable[[str], int]] = {}


def encoding(vocabulary: str = VOCABULARY):  # noqa: ANN201
    """The tokenizer of a vocabulary file of ranks."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Pieces(dict):
    """Counts of pieces that follow a space, filled on demand."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(" " + piece))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


def counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """A function that counts the tokens of a text, made once per process."""
    if vocabulary not in _counters:
        encode = encoding(vocabulary).encode_ordinary
        pieces = _Pieces(encode)

        def count(text: str) -> int:
            if _IRREGULAR.search(text):
                # Only around these spaces do pieces and pre-tokens not line up.
                return len(encode(text))
            first, *rest = text.split(" ")
            return len(encode(first)) + sum(map(pieces.__getitem__, rest))

        _counters[vocabulary] = count
    return _counters[vocabulary]


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of a text as bigint; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary)
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return count_all(F.col(text) if isinstance(text, str) else text)


def sized(documents: DataFrame, *columns: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, *columns, tokens): the documents with their sizes, without their texts."""
    return documents.select("doc_id", *columns, token_count("text", vocabulary).alias("tokens"))
