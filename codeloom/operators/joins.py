"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.session import written

# Rows of one key above which its rows are spread over several tasks. The number of such
# keys is at most (rows / HOT_ROWS), so the list of them is always small enough to broadcast.
HOT_ROWS = 5_000_000


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of ``on`` with more than ``hot_rows`` rows, counted with map-side combine, and into how many parts each is
    to be split: ``_salts``, in proportion to its rows."""
    return (
        df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
        .select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts"))
    )


#: Keys up to this number are broadcast.
MOST_BROADCAST = 200_000


def listed(hot: DataFrame, keys: int | None = None) -> DataFrame:
    """``hot`` for a join: broadcast if it has few ``keys``. Unless told, they are taken to be few, as they are at ``HOT_ROWS``; where much less
    makes a key hot, they may be nearly all keys, and then they are shuffled."""
    return F.broadcast(hot) if keys is None or keys <= MOST_BROADCAST else hot


def with_salt(df: DataFrame, on: list[str], hot: DataFrame, keys: int | None = None) -> DataFrame:
    """``df`` with ``_salt``: a part of the key for the rows of hot keys, by a hash of the row, and 0 for others. ``keys`` is the
    number of hot ones, if known."""
    row = F.xxhash64(*df.columns)
    return df.join(listed(hot, keys), on, "left").withColumn(
        "_salt", F.coalesce(F.pmod(row, F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")


def with_every_salt(df: DataFrame, on: list[str], hot: DataFrame, keys: int | None = None) -> DataFrame:
    """``df`` with a row for each part that its key is split into."""
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    return df.join(listed(hot, keys), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join on ``on`` (inner, left, left_semi or left_anti) with the hot keys of ``big`` split by their size. Rows of
    ``big`` with a null key match nothing and are kept out of the shuffle's way by a hash of the row."""
    hot = hot_keys(big.dropna(subset=on), on, hot_rows)
    no_key = _any_null(on)
    left = with_salt(big, on, hot).withColumn(
        "_salt", F.when(no_key, F.pmod(F.xxhash64(*big.columns), F.lit(1 << 16)).cast("int")).otherwise(F.col("_salt")))
    return left.join(with_every_salt(small, on, hot), [*on, "_salt"], how).drop("_salt")


def _any_null(on: list[str]) -> Column:
    cond = F.lit(False)
    for name in on:
        cond = cond | F.col(name).isNull()
    return cond


def keep_last(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order``. Combined map-side, no window."""
    return _kept(df, key, order, F.max_by)


def keep_first(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row per ``key``: the one with the least ``order``."""
    return _kept(df, key, order, F.min_by)


def _kept(df: DataFrame, key: list[str], order: list[str | Column], chosen) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(chosen(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*key, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def by_repeats(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``df`` in two: rows whose key surely has no other row, and the rest (None if there is none). Only 64-bit hashes of the
    keys are shuffled and counted, and a list of those that come more than once is written. For tables that are cheap to read again."""
    seen = Observation()
    hashed = df.withColumn("_key", F.xxhash64(*key))
    twice = written(hashed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_key")
                    .observe(seen, F.count(F.lit(1)).alias("rows")), "repeated-keys")
    if not seen.get["rows"]:
        return df, None
    return tuple(hashed.join(twice, "_key", how).drop("_key") for how in ("left_anti", "left_semi"))


def keep_last_of_few(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """``keep_last`` where most keys have one row: only the others are sorted and shuffled."""
    alone, again = by_repeats(df, key)
    return alone if again is None else alone.unionByName(keep_last(again, key, order))


def keep_first_of_few(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """``keep_first`` where most keys have one row."""
    alone, again = by_repeats(df, key)
    return alone if again is None else alone.unionByName(keep_first(again, key, order))


def distinct_of_few(df: DataFrame) -> DataFrame:
    """The distinct rows of a table where most rows come once."""
    alone, again = by_repeats(df, df.columns)
    return alone if again is None else alone.unionByName(again.distinct())


def spread(df: DataFrame, *columns: str, least: int = 1) -> DataFrame:
    """``df`` dealt out anew, for work on texts that costs far more than the shuffle: over at least twice the cores, as
    many partitions as a shuffle has, or ``least``."""
    spark = df.sparkSession
    n = max(least, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *columns)
