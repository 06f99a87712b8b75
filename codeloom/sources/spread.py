"""Rows that name files, dealt to reading tasks by the files' sizes.

Such rows are tiny, so that a shuffle by key is joined into one task again by
adaptive execution, and a hash knows nothing of sizes. Here every file gets a place on
a running sum of all sizes, and the sum is cut into parts of equal length, one
task each.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bytes a task reads at most, but for a single file that is larger, and what opening a file counts as.
READ_BYTES = 128 << 20
OPEN_BYTES = 4 << 20
# Files whose running sum is taken together.
_TOGETHER = 10_000


def dealt(files: DataFrame, *keys: str, size: str | None = None, most: int = READ_BYTES, opening: int = OPEN_BYTES) -> DataFrame:
    """``files`` in partitions of at most ``most`` bytes and the file that crosses that, in order of their place.

    ``size`` names the column of bytes, without it, or where it is null, a file counts
    for its opening alone. A little work is spread over all cores all the same. ``files``
    is read three times; pass a stored table. The driver sees one sum per 10,000 files.
    """
    spark = files.sparkSession
    cost = F.lit(opening).cast("long")
    if size:
        cost = cost + F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("cost")).first()
    if not total.n:
        return files
    share = min(most, max(opening, -(-total.cost // spark.sparkContext.defaultParallelism)))
    taken = {c.lower() for c in files.columns}
    cost_, group, part, start = (
        next(n for n in (f"{'_' * i}{name}" for i in range(1, 99)) if n not in taken) for name in ("cost", "group", "part", "start"))
    groups = -(-total.n // _TOGETHER)
    placed = files.withColumns({cost_: cost, group: F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")})
    before = F.coalesce(F.sum(cost_).over(Window.partitionBy(group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if groups > 1:
        sums = sorted(map(tuple, placed.groupBy(group).agg(F.sum(cost_)).collect()))
        begins = [0, *accumulate(s for _, s in sums)]
        offsets = spark.createDataFrame([(g, begin) for (g, _), begin in zip(sums, begins)], f"{group} int, {start} long")
        placed = placed.withColumn(part, before).join(F.broadcast(offsets), group)
        placed = placed.withColumn(part, F.floor((F.col(part) + F.col(start)) / share).cast("int")).drop(start)
    else:
        placed = placed.withColumn(part, F.floor(before / share).cast("int"))
    # By number, so that neither hashing nor adaptive execution puts parts together.
    return placed.repartitionById(int(total.cost // share) + 1, part).drop(cost_, group, part)
