"""Token counts through a digest cache.

A document's content is named by the SHA-256 digest of its normalised text, and a tokenizer by
the digest of its file. Stored counts are looked up by both. Only distinct contents without a
stored count are encoded, whole; their counts are appended to the cache, and every document
takes its count from there. Copies are reduced to one row per task before the text is
shuffled, so a content with a third of all rows is not gathered anywhere.

Normalising must not change a count: null becomes the empty text, and nothing else changes.

Encoding is the library's. For a byte-level BPE in JSON, a text is cut where the tokenizer's own
pre-tokenisation always cuts (before a single white-space character between two others), and
the counts of pieces are remembered in the task; a text with an added token's string, or with one
of the control characters on which the two definitions of white space differ, is encoded in one
piece.

Defined results: null and empty texts have 0 bytes and 0 tokens; bytes that are not UTF-8 count
as U+FFFD; repeated rows each get their
count; null ids are kept; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.text import readable

CACHE = "tokenizer string, digest binary, n_tokens bigint"
OVER_LIMIT = 512
# Characters that are encoded together, and pieces that a task remembers.
CHUNK_CHARS = 1_000_000
REMEMBERED_PIECES = 600_000
LONGEST_REMEMBERED = 48

_PIECES = re.compile(r"\s?\S+|\s+(?=\s\S)|\s+")
_DIFFERS = re.compile("[\x1c-\x1f]")


def tokenizer_version(path: str) -> str:
    """The digest of a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts with the tokenizer in ``path``: ``tokenizers``
    for .json, ``sentencepiece`` for .model. No begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encoded(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not _splits_at_white_space(path):
        return encoded
    memo: dict[str, int] = {}
    # An added token in a text ends the piece before it, which moves the cuts.
    added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    uncut = re.compile("|".join([_DIFFERS.pattern, *added]))

    def count(texts: list[str]) -> list[int]:
        cut = [[t] if uncut.search(t) else _PIECES.findall(t) for t in texts]
        if len(memo) > REMEMBERED_PIECES:
            memo.clear()
        new = list({p for pieces in cut for p in pieces if p not in memo})
        found = dict(zip(new, encoded(new), strict=True))
        look = memo | found if len(memo) < len(found) else None
        memo.update((p, n) for p, n in found.items() if len(p) <= LONGEST_REMEMBERED)
        if look is None:
            look = memo
            long = {p: n for p, n in found.items() if len(p) > LONGEST_REMEMBERED}
            if long:
                return [sum(long[p] if p in long else look[p] for p in pieces) for pieces in cut]
        return [sum(map(look.__getitem__, pieces)) for pieces in cut]

    return count


def _splits_at_white_space(path: str) -> bool:
    """Whether the tokenizer is a byte-level BPE that cuts by its own pattern and nothing else."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    special = [t["content"] for t in spec.get("added_tokens") or []]
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(re.search(r"\s", t) for t in special)
        and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or [])
    )


_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def _encode(path: str, shipped: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = SparkFiles.get(os.path.basename(path)) if shipped else path
        if local not in _counters:
            _counters[local] = counter(local)
        count = _counters[local]
        for batch in batches:
            counts: list[int] = []
            held: list[str] = []
            chars = 0
            for text in batch.column(1):
                held.append(text.as_py())
                chars += len(held[-1])
                if chars > CHUNK_CHARS:
                    counts += count(held)
                    held, chars = [], 0
            counts += count(held) if held else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    return encode


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    ship: bool = False,
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` for every row of ``docs``.

    ``cache_path`` is a table of counts that grows with every call. ``tokenizer_path`` must be
    readable on every executor; with ``ship`` the driver's file is sent to them.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    if ship:
        spark.sparkContext.addFile(tokenizer_path)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)

    def stored() -> DataFrame:
        # Two writers may both have stored a content; the counts are equal.
        cache = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version)
        return cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    content = F.coalesce(readable(F.col(text_col)), F.lit(""))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    distinct = docs.select(digest, content.alias("text")).dropDuplicates(["digest"])
    misses = distinct.join(stored().select("digest"), "digest", "left_anti")
    counted = misses.select("digest", "text").mapInArrow(
        _encode(tokenizer_path, ship), "digest binary, n_tokens bigint"
    )
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode(
        "append"
    ).parquet(cache_path)

    # Joined on the digest's hex form: the (small) counts are then shuffled once more after their
    # aggregation, and Spark can split the rows of a very frequent content.
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.sha2(content, 256).alias("name"),
        F.octet_length(content).cast("bigint").alias("n_bytes"),
    )
    counts = stored().select(F.lower(F.hex("digest")).alias("name"), "n_tokens")
    return rows.join(counts, "name").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
