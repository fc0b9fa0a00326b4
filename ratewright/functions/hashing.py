"""Content hashes: the same row gets the same value whatever the partitioning or row order.

Two modes. ``xxhash64`` is the fast default. ``md5`` costs more per row and gives values
that any SQL engine with an MD5 function can reproduce.

Each use of a hash that should be independent of the others (folds, samples, shuffles of
one user's ratings) passes its own ``salt``; without that, a fold number taken from rows
that already passed a split on the same hash would be badly unbalanced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

XXHASH64 = "xxhash64"
MD5 = "md5"

# order_hash values lie in [0, ORDER_SPACE).
ORDER_SPACE = 1 << 32


def row_hash(columns: Sequence[str], mode: str = XXHASH64, salt: str | None = None) -> Column:
    """Hash of the columns as BIGINT; signed for xxhash64, below 2^32 for md5."""
    parts = [F.col(c) for c in columns]
    if salt is not None:
        parts.append(F.lit(salt))
    if mode == XXHASH64:
        return F.xxhash64(*parts)
    if mode == MD5:
        digest = F.md5(F.concat_ws("|", *parts))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    raise ValueError(f"unknown hash mode {mode!r}; use {XXHASH64!r} or {MD5!r}")


def order_hash(columns: Sequence[str], mode: str = XXHASH64, salt: str | None = None) -> Column:
    """Hash in [0, 2^32), for ordering rows at random and for cutting that order into ranges."""
    value = row_hash(columns, mode, salt)
    return F.shiftrightunsigned(value, 32) if mode == XXHASH64 else value
