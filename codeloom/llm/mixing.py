"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is what takes its share of all text to its
target weight: ``weight * total / size of the source``. Each document is repeated
as often as a Poisson variable with that mean says; the variable is found by
inverting the distribution at a number in [0, 1) hashed from seed and document,
so that a rerun, or a recomputed task, repeats the same documents. The copies
are then dealt and ordered by a hash of seed, document and copy.

Means over ``PART`` are split into equal parts whose counts are added, each
inverted at a number of its own: a sum of Poisson variables is one, and no
exponential underflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, counted_broadcast, fresh, without

# Largest mean that is inverted at once, and where the inversion of such a mean ends at the latest.
PART = 16
STEPS = 120


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in every engine."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def _inverse(unit: Column, mean: Column) -> Column:
    """Smallest k with P(X <= k) > unit for X of a Poisson distribution of that mean."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("below"))
    step = lambda s, i: F.when(
        unit >= s["below"],
        F.struct((s["k"] + 1).alias("k"), (s["p"] * mean / i).alias("p"), (s["below"] + s["p"] * mean / i).alias("below")),
    ).otherwise(s)
    # The loop stops where the mass left is far below the resolution of the hashed number.
    last = F.least(F.lit(STEPS), F.ceil(mean * 4 + 30)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def poisson_count(mean: Column, seed: int, *key: Column) -> Column:
    """Hash-seeded Poisson variable of the given mean; 0 for a mean of 0 or less."""
    parts = F.greatest(F.ceil(mean / PART), F.lit(1)).cast("int")
    counts = F.transform(
        F.sequence(F.lit(1), parts),
        lambda i: _inverse(hashed_unit(F.lit(seed), F.lit("count"), *key, i), mean / parts))
    return F.when(mean > 0, F.aggregate(counts, F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0))


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """(source, size, weight, rate) over all documents.

    ``weights`` gives target weights by source, scaled to a sum of 1; a source not
    named has weight 0. Without ``weights`` every source has the same. ``size`` is the
    number of characters of its texts (null: none). A null source is a source of
    its own, which ``weights`` names ''. A source without any text can't take a
    weight: its rate is 1.
    """
    sizes = Scratch(docs.sparkSession, "sizes").keep(docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.coalesce(F.char_length(text_col), F.lit(0)).cast("bigint")).alias("size")))
    if weights:
        scale = float(sum(weights.values()))
        named = F.create_map(*(x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(float(w) / scale))))
        weight = F.coalesce(F.try_element_at(named, F.coalesce("source", F.lit(""))), F.lit(0.0))
        total = sizes.agg(F.sum("size")).first()[0]
    else:
        total, number = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
        weight = F.lit(1.0 / max(number, 1))
    return sizes.select(
        "source", "size", weight.alias("weight"),
        F.coalesce(F.try_divide(weight * F.lit(float(total or 0)), F.col("size").cast("double")), F.lit(1.0)).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with each row repeated, plus ``copy`` (from 1), ``n_copies``, ``rate`` and ``mix_key``.

    Rows are dealt by ``mix_key`` and ordered by it within each partition. A row whose
    count is 0 is left out. Rows with equal ids are repeated equally often; a null
    id counts as an empty one. An empty table gives no rows.
    """
    kept = without(docs, ["copy", "n_copies", "rate", "mix_key"])
    plain, key = docs.select(*kept), lambda: F.col(id_col)
    of, mean = fresh(plain, "of"), fresh(plain, "mean")
    rates = source_rates(docs, weights, source_col, text_col).select(F.col("source").alias(of), F.col("rate").alias(mean))
    joined = plain.join(counted_broadcast(rates), F.col(source_col).eqNullSafe(F.col(of)))
    counted = joined.select(*kept, F.col(mean).alias("rate"), poisson_count(F.col(mean), seed, key()).alias("n_copies"))
    copies = counted.filter("n_copies > 0").select(
        *kept, "rate", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    order = copies.withColumn("mix_key", hashed_unit(F.lit(seed), F.lit("order"), key(), F.col("copy")))
    return order.repartition("mix_key").sortWithinPartitions("mix_key", id_col, "copy")
