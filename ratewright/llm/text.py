"""Helpers shared by the text operators: words, word hashes and document keys."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same places.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Hashes of this many different words are remembered in a task, then forgotten together.
REMEMBERED_WORDS = 400_000
# Bytes of rows that a task hands to its Python worker at a time; Spark's own limit is 64 MB.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words that come again."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word (the SplitMix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bound_batches(spark: SparkSession) -> None:
    """Have rows with whole texts go to Python in batches of ``BATCH_BYTES``, one row at least.

    A batch exists several times: in the buffers of the JVM, in the worker, and as the worker's
    result. The option stays set, because frames run when the caller asks; one that the session
    has set already stands.
    """
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def id_key(docs: DataFrame, id_col: str) -> Column:
    """An id as a non-null BIGINT: integers as they are, other types by hash."""
    column = F.col(id_col)
    if isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        return F.coalesce(column.cast("bigint"), F.lit(-(1 << 63)))
    return F.xxhash64(column)


def document_keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """``_id`` and ``_th`` (64-bit hash of the text): they name a document even where ids are null
    or repeat with different texts. Rows that repeat both share them. Without an id, ``_id`` is
    a second hash of the text, so that 128 bits tell such texts apart."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    unnamed = F.xxhash64(F.lit("no id"), F.col(text_col).isNull(), text)
    return [
        F.when(F.col(id_col).isNull(), unnamed).otherwise(id_key(docs, id_col)).alias("_id"),
        F.xxhash64(F.col(text_col).isNull(), text).alias("_th"),
    ]


def readable(column: Column) -> Column:
    """A text as a string, bytes that are not UTF-8 as U+FFFD."""
    return F.make_valid_utf8(column.cast("string"))


def utf8(text_col: str) -> Column:
    """A text as bytes, null as empty."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
