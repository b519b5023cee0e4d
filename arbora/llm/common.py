"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.operators.fixpoint import checkpoint, components, ensure_checkpoint_dir

__all__ = ["WORD", "checkpoint", "components", "crc_mod", "ensure_checkpoint_dir", "seeded_hash", "sha256_hex", "slices", "word_count"]

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, without building a list of them; null text: 0."""
    one = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.regexp_replace(one, "[^x]+", "")), F.lit(0)).cast("long")


def seeded_hash(*cols: Column, seed: str = "") -> Column:
    """A 32-bit number from MD5, the same in Spark and in other SQL engines."""
    joined = F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that a worker holds Python copies of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
