"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

``targets`` shares a budget of words between the sources by weight; a source stops at ``cap``
times its size, and what it can't take is shared by weight among the others. In closed form: a
source of weight w gets min(level * w, cap * size) for the one level at which all add up, found
by a prefix sum over the sources in the order in which they reach their cap.

``draw`` gives each document of a source the same expected copies, target / size of the source.
The documents stand in a fixed order; the running sum of expected copies, moved by one offset
per source, crosses some integers within each document, and the document is taken once for
each. The order is by size class, so that the words taken come near the target as well.

The running sum is rank x rate. Ranks of a source with a third of all rows don't go through one
task: documents are counted by (source, size class) and by (source, size class, slice of a hash), and
running sums over the few classes of a source and the ``SLICES`` slices of a class give each
slice its first rank; documents are numbered within their slice only.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
documents of size 0 are taken like any other and take no words; repeated rows are documents of
their own; an empty table has no rows. Other columns are not read. The offsets and slices come
from MD5 digests, so a run can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.text import WORD_PATTERN

# Fixed values of the mix: the weights in turn, the share of all words, the cap per source.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
# Ranks are counted in so many slices of each size class of a source.
SLICES = 1024
SALT = "mix"


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of a string."""
    digits = F.substring(F.md5(text), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 32))


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size``, ``docs``, ``target`` for every source of ``sized``
    (``source``, ``size``).

    One row per source goes through single-task windows: the number of sources, not of
    documents, bounds them.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        .withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn(
            "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1).cast("double")
        )
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("full_at", F.col("most") / F.col("weight"))
    )
    filling = every.orderBy("full_at", F.col("source").asc_nulls_last())
    done = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    words = F.sum("source_size").over(every) * F.lit(budget)
    # The level if exactly the sources before this one are full. Taking full sources for open
    # ones, or the other way round, only lowers it: the highest is the one that holds.
    level = (words - F.coalesce(F.sum("most").over(done), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = sources.withColumn("level", level).withColumn("level", F.max("level").over(every))
    target = F.least(F.col("level") * F.col("weight"), F.col("most"))
    return leveled.select("source", "source_size", "docs", target.alias("target"))


def draw(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    salt: str = SALT,
    whole_rows: bool = False,
    **shares,
) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target`` (of its source) and ``copies``,
    the times the mix takes the document, one row per row of ``docs``; with ``whole_rows`` also
    ``row``, all columns of the document as a struct."""
    spread = _unit(
        F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(salt))
    )
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        spread.alias("spread"),
        *([F.struct(*docs.columns).alias("row")] if whole_rows else []),
    )
    bits = F.length(F.bin("size"))
    lead = F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")
    placed = sized.select(
        "*",
        (bits * 16 + lead).cast("int").alias("class"),
        F.floor(F.col("spread") * SLICES).cast("int").alias("slice"),
    )

    # First ranks of the slices: classes before it in the source, slices before it in the class.
    def running(name: str, count: str, group: list[str], order: str) -> Column:
        before = Window.partitionBy(*group).orderBy(order)
        total = F.sum(count).over(before.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(total, F.lit(0)).alias(name)

    slices = placed.groupBy("source", "class", "slice").agg(F.count("*").alias("n"))
    in_class = slices.select("*", running("in_class", "n", ["source", "class"], "slice"))
    classes = slices.groupBy("source", "class").agg(F.sum("n").alias("n"))
    in_source = classes.select("*", running("in_source", "n", ["source"], "class")).drop("n")
    shared = targets(sized, **shares).withColumn(
        "offset", _unit(F.concat_ws("|", F.col("source"), F.lit(salt)))
    )
    by_class = _join(in_source, shared.drop("docs"), ["source"])
    starts = _join(in_class, by_class, ["source", "class"]).drop("n")

    own = Window.partitionBy("source", "class", "slice").orderBy("size", "spread", "id")
    ranked = _join(placed, starts, ["source", "class", "slice"]).withColumn(
        "rank", F.row_number().over(own) + F.col("in_class") + F.col("in_source")
    )
    rate = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    crossed = F.floor(F.col("rank") * rate + F.col("offset")) - F.floor(
        (F.col("rank") - 1) * rate + F.col("offset")
    )
    return ranked.select(
        "id", "source", "size", "source_size", "target",
        F.coalesce(crossed, F.lit(0)).cast("bigint").alias("copies"),
        *(["row"] if whole_rows else []),
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; every row of ``left`` has its one partner."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return left.join(renamed, on).drop(*(f"_{k}" for k in keys))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, in the columns of ``docs``."""
    taken = draw(docs, whole_rows=True, **options).filter("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.select("row", copies.alias("nth")).select("row.*")


def op8_mixing_sql() -> str:
    """DuckDB SQL for the rows of the query on ``documents``."""
    words = r"[^\x20\x09-\x0D]+"
    unit = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"
    spread = unit.format(f"concat_ws('|', doc_id, md5(text), '{SALT}')")
    offset = unit.format(f"concat_ws('|', source, '{SALT}')")
    turns = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
    WITH d AS (
      SELECT doc_id, source, {spread} AS spread,
             CAST(coalesce(len(regexp_extract_all(text, '{words}')), 0) AS BIGINT) AS size
      FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (
      SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}
                     {turns} END AS DOUBLE) AS weight, CAST(source_size * {CAP} AS DOUBLE) AS most
      FROM s),
    f AS (
      SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST({BUDGET} AS DOUBLE)
                 - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
    t AS (
      SELECT source, source_size, {offset} AS u,
             least(max(level) OVER () * weight, most) AS target
      FROM f),
    r AS (
      SELECT doc_id, d.source, size, source_size, target, u,
             target / nullif(source_size, 0) AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY
               length(bin(size)) * 16 + (size >> CAST(greatest(length(bin(size)) - 4, 0) AS BIGINT)),
               floor(spread * {SLICES}), size, spread, doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(coalesce(floor(k * rate + u) - floor((k - 1) * rate + u), 0) AS BIGINT) * size
             AS taken
    FROM r"""
