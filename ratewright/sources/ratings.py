"""Ratings readers.

The file schema is given, so no reader scans the data twice to infer types; inference stays
available for tab files because the notebooks this replaces used it. A row becomes canonical
only if nothing is lost on the way: all four values are there, the line has as many fields as
the format, each value fits its type unchanged (no fractional or oversized key) and the
rating is finite. Every other row is kept apart in ``rejected``: training fails on some of
them, and a hash that skips NULLs would still place them in a split. To see a line's further
fields the whole line is parsed, so text sources don't prune columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewright import schema as S

RATINGS_DDL = "user_id BIGINT, item_id BIGINT, rating DOUBLE, timestamp BIGINT"
HEADER_DDL = "userId BIGINT, movieId BIGINT, rating DOUBLE, timestamp BIGINT"
HEADER_NAMES = {"userId": S.USER, "movieId": S.ITEM}
CORRUPT = "_corrupt_record"
USABLE = "usable"
SOURCE_FILE, SOURCE_BLOCK = "source_file", "source_block"
READ, KEPT, REJECTED = "read_rows", "kept_rows", "rejected_rows"


class _Parsed(NamedTuple):
    ratings: DataFrame
    rejected: DataFrame | None


class ParsedRatings(_Parsed):
    """Canonical rows, and the rows that could not become canonical: a pair.

    ``source``, where the reader has it, is every row that was read: the canonical values and
    USABLE, which tells the two kinds apart in one pass (see ``observed``).
    """

    source: DataFrame | None = None

    def observed(self, seen: Observation) -> DataFrame:
        """``ratings``, with ``read_rows``, ``kept_rows`` and ``rejected_rows`` counted by ``seen``
        in the pass that consumes them. Without ``source`` no rejected rows are seen."""
        read = F.count(F.lit(1))
        if self.source is None:
            none = F.count_if(F.lit(False)).alias(REJECTED)
            return self.ratings.observe(seen, read.alias(READ), read.alias(KEPT), none)
        kept, lost = F.count_if(F.col(USABLE)), F.count_if(~F.col(USABLE))
        rows = self.source.observe(seen, read.alias(READ), kept.alias(KEPT), lost.alias(REJECTED))
        return rows.filter(USABLE).select(*S.RATING_COLUMNS)


def _fits(frame: DataFrame, name: str, value: Column) -> Column:
    """Whether a column's value became ``value`` unchanged. Only numbers and text can."""
    kind = frame.schema[name].dataType
    if not isinstance(kind, (T.NumericType, T.StringType)):
        return F.lit(False)
    kept = value.isNotNull()
    if name == S.RATING:
        return kept & (F.abs(value) < F.lit(float("inf")))  # false for NaN
    if isinstance(kind, T.DecimalType):
        return kept & (value.cast("decimal(38,18)") == F.col(name).try_cast("decimal(38,18)"))
    if isinstance(kind, (T.FractionalType, T.StringType)):
        return kept & (value.cast("double") == F.col(name).try_cast("double"))
    return kept


def _usable(frame: DataFrame) -> tuple[Column, dict[str, Column]]:
    """Whether a row is a rating, and its canonical values."""
    usable, cast = F.lit(True), {}
    for field in S.RATINGS.fields:
        name = field.name
        convertible = isinstance(frame.schema[name].dataType, (T.NumericType, T.StringType))
        value = F.col(name).try_cast(field.dataType) if convertible else F.lit(None).cast(field.dataType)
        cast[name] = value
        usable &= _fits(frame, name, value)
    if CORRUPT in frame.columns:
        usable &= F.col(CORRUPT).isNull()
    return F.coalesce(usable, F.lit(False)), cast


def parse_ratings(frame: DataFrame) -> ParsedRatings:
    """Cast to the canonical types and separate the rows that do not fit them.

    ``frame`` has the canonical names; other columns are kept in ``rejected`` only, which also
    has ``source_file`` and ``source_block`` (the byte where the read block starts) if the rows
    come from files. Columns that are neither numbers nor text (booleans, dates, arrays) hold no
    ratings: all their rows are rejected.
    """
    usable, cast = _usable(frame)
    canonical = [c.alias(n) for n, c in cast.items()]
    parsed = ParsedRatings(
        frame.filter(usable).select(*canonical), _with_provenance(frame).filter(~usable)
    )
    parsed.source = frame.select(*canonical, usable.alias(USABLE))
    return parsed


def _with_provenance(frame: DataFrame) -> DataFrame:
    """Where each row was read, if it was read from files."""
    try:
        return frame.select(
            *frame.columns,
            F.col("_metadata.file_path").alias(SOURCE_FILE),
            F.col("_metadata.file_block_start").alias(SOURCE_BLOCK),
        )
    except AnalysisException:  # rows of no file
        return frame


def _read_text(
    spark: SparkSession, path: str | list[str], ddl: str, **options: object
) -> DataFrame:
    return (
        spark.read.options(columnNameOfCorruptRecord=CORRUPT, mode="PERMISSIVE", **options)
        .schema(f"{ddl}, {CORRUPT} STRING")
        .csv(path)
    )


def _tab_frame(spark: SparkSession, path: str | list[str], infer_schema: bool) -> DataFrame:
    ddl = RATINGS_DDL
    if infer_schema:
        # The types only; the rows are read with them, so that further fields are noticed.
        inferred = spark.read.csv(path, sep="\t", inferSchema=True).dtypes
        kinds = [kind for _, kind in inferred[:4]] + ["string"] * (4 - len(inferred))
        ddl = ", ".join(f"{n} {k}" for n, k in zip(S.RATING_COLUMNS, kinds, strict=True))
    return _read_text(spark, path, ddl, sep="\t")


def read_tab(spark: SparkSession, path: str, infer_schema: bool = False) -> ParsedRatings:
    """Tab-separated text without a header; columns are taken by position."""
    return parse_ratings(_tab_frame(spark, path, infer_schema))


def read_double_colon(spark: SparkSession, path: str) -> ParsedRatings:
    """``user::item::rating::timestamp`` text without a header."""
    return parse_ratings(_read_text(spark, path, RATINGS_DDL, sep="::"))


def read_header_csv(spark: SparkSession, path: str) -> ParsedRatings:
    """CSV with the header ``userId,movieId,rating,timestamp``."""
    frame = _read_text(spark, path, HEADER_DDL, header=True)
    return parse_ratings(frame.withColumnsRenamed(HEADER_NAMES))


def read_parquet(spark: SparkSession, path: str) -> ParsedRatings:
    """Parquet with the canonical column names; other key types are converted with a check."""
    return parse_ratings(spark.read.parquet(path))


class ParsedFold(NamedTuple):
    """Train and test ratings of a fold, and the rows of either file that are not ratings."""

    train: DataFrame
    test: DataFrame
    rejected: DataFrame


def read_fold(
    spark: SparkSession,
    base: str,
    fold: int,
    train: str = "u{fold}.base",
    test: str = "u{fold}.test",
    infer_schema: bool = False,
) -> ParsedFold:
    """One ready-made fold, from a path template. ``rejected`` names its ``part``."""
    paths = (f"{base.rstrip('/')}/{name.format(fold=fold)}" for name in (train, test))
    train_rows, test_rows = (read_tab(spark, p, infer_schema) for p in paths)
    rejected = train_rows.rejected.withColumn("part", F.lit("train")).unionByName(
        test_rows.rejected.withColumn("part", F.lit("test")), allowMissingColumns=True
    )
    return ParsedFold(train_rows.ratings, test_rows.ratings, rejected)


FOLD, PART = "fold", "part"


class _Folds(NamedTuple):
    ratings: DataFrame
    rejected: DataFrame


class ParsedFolds(_Folds):
    """All folds in one frame each: canonical rows and rejected ones, with ``fold`` and ``part``
    ('train' or 'test').

    ``source`` is every row that was read: the canonical values, USABLE, ``fold`` and ``part``.
    Who wants both kinds of row reads the files once there, not once for each kind.
    """

    source: DataFrame | None = None

    def pair(self, fold: int) -> tuple[DataFrame, DataFrame]:
        """Train and test ratings of one fold."""
        own = self.ratings.filter(F.col(FOLD) == fold)
        return tuple(own.filter(F.col(PART) == p).drop(FOLD, PART) for p in ("train", "test"))


def read_folds(
    spark: SparkSession,
    base: str,
    folds: Sequence[int] = range(1, 6),
    train: str = "u{fold}.base",
    test: str = "u{fold}.test",
    infer_schema: bool = False,
) -> ParsedFolds:
    """Ready-made folds, all files of a template in one scan.

    The fold and the part of a row come from the path of the file it was read from. A file that
    is missing is an error, as with ``read_fold``.
    """
    root = base.rstrip("/")
    kinds = {"train": train, "test": test}
    paths = [f"{root}/{name.format(fold=n)}" for n in folds for name in kinds.values()]
    frame = _tab_frame(spark, paths, infer_schema)
    # File paths are URIs, so names are decoded before they are compared, where they need it.
    path = F.col("_metadata.file_path")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    path = F.when(F.contains(path, F.lit("%")), decoded).otherwise(path)
    fold, part = F.lit(None).cast("int"), F.lit(None).cast("string")
    for label, name in kinds.items():
        # The last names of the path are a fold's, of the file itself or of its directory. They
        # are looked up: a regular expression would cost each row more than its parsing.
        depth = name.count("/") + 1
        folder = F.substring_index(F.substring_index(path, "/", -depth - 1), "/", depth)
        number = F.lit(None).cast("int")
        for tail in (F.substring_index(path, "/", -depth), folder):
            for n in folds:
                number = F.when(tail == name.format(fold=n), F.lit(n)).otherwise(number)
        fold = F.coalesce(number, fold)
        part = F.when(number.isNotNull(), F.lit(label)).otherwise(part)
    usable, canonical = _usable(frame)
    keys = (fold.alias(FOLD), part.alias(PART))
    marked = frame.select(
        F.struct(*(canonical[n].alias(n) for n in S.RATING_COLUMNS)).alias("_row"),
        F.struct(*frame.columns).alias("_line"),
        usable.alias(USABLE), *keys,
        F.col("_metadata.file_path").alias(SOURCE_FILE),
        F.col("_metadata.file_block_start").alias(SOURCE_BLOCK),
    )
    parsed = ParsedFolds(
        marked.filter(USABLE).select("_row.*", FOLD, PART),
        marked.filter(~F.col(USABLE)).select("_line.*", FOLD, PART, SOURCE_FILE, SOURCE_BLOCK),
    )
    parsed.source = marked.select("_row.*", USABLE, FOLD, PART)
    return parsed
