"""Sizes of texts in tokens of a public tokenizer whose vocabulary file lies outside the library."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.frames import map_batches, record

#: Fixed value: the public split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def counter(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), vocabulary: str | None = None) -> DataFrame:
    """(key, keep..., n_tokens). Whole texts are encoded; null texts have 0 tokens. Special tokens count as plain text."""
    path = vocabulary or default_vocabulary()
    rows = df.select(F.col(key), *keep, F.col(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_tokens int"

    def make():
        enc = counter(path)

        def f(b: pa.RecordBatch):
            sizes = [len(t) for t in enc.encode_ordinary_batch([t or "" for t in b.column(b.num_columns - 1).to_pylist()], num_threads=1)]
            return record(**{b.schema.names[i]: b.column(i) for i in range(b.num_columns - 1)}, n_tokens=pa.array(sizes, pa.int32()))

        return f

    return map_batches(rows, make, schema)
