"""Token counts of whole texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoder(path: str = VOCABULARY):
    """The encoder of a rank file, once for each process."""
    import tiktoken

    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("palaver", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def counted(docs: DataFrame, columns: list[str], path: str = VOCABULARY) -> DataFrame:
    """``columns`` of ``docs`` and ``n_tokens`` of the whole ``text``; 0 for null and empty texts."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema] + ["n_tokens long"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, type=pa.int64())], names=[*columns, "n_tokens"])

    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(scan, schema)
