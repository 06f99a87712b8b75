"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import scratch_path

# A side of a join is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str, *others: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` that are not among ``names``."""
    names = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in names]


class Scratch:
    """Tables written to the shared folder; those no longer read can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        if id(df) in self.paths:
            remove(self.spark, self.paths.pop(id(df))[1])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote below the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def counted_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    ``df`` is read twice; pass a written table or a small aggregate of one.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_unique(rows: DataFrame, one: DataFrame, key: str, count: str, total: int | None = None, most: int = 10_000) -> DataFrame:
    """``rows`` joined with ``one``, which has a single row per ``key`` and, as ``count``, how many of ``rows`` have it.

    Keys of more than one in ``most`` rows, of which there are ``most`` at the most, are
    broadcast, so that no task gets all rows of one; the others meet by shuffling.
    ``one`` is read three times, once less with the ``total`` of its counts; pass a
    written table or a small aggregate of one.
    """
    if total is None:
        total = one.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(total // most, 1000)
    often = one.filter(hot)
    seldom = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(one.filter(~hot).hint("merge"), key)
    return seldom.unionByName(rows.join(F.broadcast(often), key))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): every node of the links (a, b), and the smallest node it is connected to.

    Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger neighbours, then every node hands it to all its smaller
    ones. Each round is two aggregates and two joins over the remaining links, is
    written to the shared folder, and the round before is removed.
    """
    now = scratch.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # The middle of a star has as many rows as the star has ends.
        handed = join_unique(both.filter("v > u"), low, "u", "n", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = handed.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        onward = join_unique(handed, low, "u", "n", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        after = scratch.keep(onward.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        marked = mark(after)
        scratch.drop(now)
        now, before, seen = after, seen, marked
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
