"""Turning chunk text into vectors with a function the user supplies."""

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import text as rules, vocab

HASH_DIM = 64


@lru_cache(maxsize=1 << 17)
def _word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:7], 16)


def hash_embed(lines: list[str], dim: int = HASH_DIM) -> np.ndarray:
    """Token counts hashed into ``dim`` slots, unit length; no model needed.

    ``lines`` are token lines. A token's slot is its MD5 value (first seven
    hex digits) modulo ``dim``.
    """
    words = [line.split() for line in lines]
    row = np.repeat(np.arange(len(lines)), [len(w) for w in words])
    slot = np.fromiter((_word_hash(w) % dim for own in words for w in own), np.int64, len(row))
    out = np.bincount(row * dim + slot, minlength=len(lines) * dim).reshape(len(lines), dim).astype(float)
    size = np.sqrt((out ** 2).sum(axis=1, keepdims=True))
    return (out / np.where(size == 0, 1, size)).astype(np.float32)


def embed(rows: DataFrame, embed_fn: Callable = hash_embed, text: str = "text",
          out: str = "embedding", batch_size: int = vocab.EMBED_BATCH,
          tokenized: bool = True) -> DataFrame:
    """Add a vector column; ``embed_fn`` gets lists of at most ``batch_size`` texts.

    With ``tokenized`` the function sees the token line, else the text itself.
    """
    source = rules.token_line(text) if tokenized else rules.col(text)
    ready = rows.withColumn("_input", source)
    schema = rows.withColumn(out, _empty_vector()).schema

    def add(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            parts = [np.asarray(embed_fn(texts[i:i + batch_size]), dtype=np.float32)
                     for i in range(0, len(texts), batch_size)]
            flat = np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.float32)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * (
                flat.shape[1] if len(texts) else 0)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
            names = batch.schema.names[:-1] + [out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=names)

    return ready.mapInArrow(add, schema)


def _empty_vector():
    from pyspark.sql import functions as F
    return F.lit(None).cast("array<float>")
