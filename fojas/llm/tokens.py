"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level vocabulary for many languages; a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# --- fixed value: the published pattern that splits text before the merges of the rank files ---
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --- end of fixed value ---

_loaded: dict = {}


def encoding(path: str = RANKS):
    """The tokenizer of a rank file, loaded once in a process."""
    import tiktoken

    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(docs: DataFrame, text_col: str, out: str = "tokens", path: str = RANKS) -> DataFrame:
    """``docs`` without ``text_col`` and with its size in tokens, a bigint column ``out``; null and empty texts have 0.

    The other columns pass through; ``out`` must not be one of them. Texts are read whole.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    rest = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(rest).schema) + f", `{out}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text_col).to_pylist()]
            yield pa.record_batch([b.column(c) for c in rest] + [pa.array(n, pa.int64())], names=[*rest, out])

    return docs.select(*[F.col(c) for c in rest], F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)
