"""Uniform shuffle into shards of exact sizes, from a hypergeometric communication matrix.

Shard sizes are fixed first (they differ by one at most).  How many rows each source partition sends to each shard is
drawn from the exact joint law of a uniform shuffle: going down a binary tree over the partitions, the left half's
share of every shard is hypergeometric given its parent's.  Rows are permuted within their partition, cut by these
counts, exchanged, and permuted again within the shard.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import written

#: Rows of a shard that one task numbers, about.
BUCKET_ROWS = 50_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, good: Column, n: Column, u: Column) -> Column:
    """Draw how many of `good` among `total` rows are in a sample of n, by inverting the distribution at u in (0, 1).

    The support is cut ten standard deviations from the mean, which leaves out less than double precision can hold.
    """
    p = good / F.greatest(total, F.lit(1))
    sd = F.sqrt(n * p * (1 - p) * F.greatest(total - n, F.lit(0)) / F.greatest(total - 1, F.lit(1)))
    low = F.greatest(F.lit(0), n + good - total, F.floor(n * p - 10 * sd - 10)).cast("long")
    high = F.least(n, good, F.ceil(n * p + 10 * sd + 10)).cast("long")

    def walk(x: Column) -> Column:
        # weight(k + 1) / weight(k), from weight(low) = 1
        ratio = lambda k: (x["good"] - k).cast("double") * (x["n"] - k) / ((k + 1).cast("double") * (x["total"] - x["good"] - x["n"] + k + 1))
        steps = F.when(x["high"] > x["low"], F.sequence(x["low"], x["high"] - 1)).otherwise(F.expr("cast(array() as array<long>)"))
        next_ = lambda s, k: _let(s["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), (k + 1).alias("k")))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), x["low"].alias("k"))
        mass = F.aggregate(steps, start, next_, lambda s: s["sum"])
        return _let(mass * x["u"], lambda goal: F.aggregate(steps, start, lambda s, k: F.when(s["sum"] >= goal, s).otherwise(next_(s, k)), lambda s: s["k"]))

    return _let(F.struct(total.alias("total"), good.alias("good"), n.alias("n"), u.alias("u"), low.alias("low"), high.alias("high")), walk)


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def communication_matrix(sizes: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """sizes (part long, n long) -> (part, counts array<long>): rows from each partition to each shard.

    Row sums are the partitions' sizes and column sums the shards' (as equal as they can be, larger ones first).
    """
    top = sizes.agg(F.coalesce(F.max("part"), F.lit(0)).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    levels = int(top["m"]).bit_length()
    total = int(top["n"])
    spark = sizes.sparkSession
    node = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(total).cast("long").alias("n"), F.array(*[F.lit(total // n_shards + (j < total % n_shards)).cast("long") for j in range(n_shards)]).alias("counts"))
    for level in range(1, levels + 1):
        below = sizes.groupBy(F.shiftright("part", levels - level).alias("child")).agg(F.sum("n").alias("child_n"))
        left = below.where(F.col("child") % 2 == 0).select(F.shiftright("child", 1).alias("node"), F.col("child_n").alias("left_n"))
        node = node.join(left, "node", "left").withColumn("left_n", F.coalesce("left_n", F.lit(0).cast("long")))
        start = F.struct(F.col("left_n").alias("left"), F.col("n").alias("pool"), F.expr("cast(array() as array<long>)").alias("out"))

        def draw(s: Column, j: Column, level: int = level) -> Column:
            good = F.col("counts")[j]
            drawn = hypergeometric(s["pool"], good, s["left"], _uniform(F.lit(seed), F.lit(level), F.col("node"), j))
            return _let(drawn, lambda d: F.struct((s["left"] - d).alias("left"), (s["pool"] - good).alias("pool"), F.concat(s["out"], F.array(d)).alias("out")))

        node = node.withColumn("__out", F.aggregate(F.sequence(F.lit(0), F.lit(n_shards - 1)), start, lambda s, j: draw(s, j), lambda s: s["out"]))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left_n").alias("n"), F.col("__out").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("left_n")).alias("n"), F.zip_with("counts", "__out", lambda a, b: a - b).alias("counts")),
        )
        node = node.select(F.inline(halves)).where("n > 0")
        if level % 4 == 0 or level == levels:
            node = written(node, "matrix")
    return node.select(F.col("node").alias("part"), "counts")


def shard(df: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (its place in the shard, gapless from 0): a uniform shuffle.

    Every row counts alone, whatever its columns hold, so nulls, repeated rows and ties need no rule.  Columns named
    shard or slot are replaced.  df is written to the shared folder once, so that rows keep their place on recovery.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    # the caller's columns travel in one of ours, so that no name clashes
    whole = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    rows = written(df.select(whole.alias("row"), F.monotonically_increasing_id().alias("rid")), "to-shard")
    part = F.shiftrightunsigned("rid", 33)
    sizes = written(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    n = int(sizes.agg(F.sum("n")).first()[0] or 0)
    matrix = communication_matrix(sizes, n_shards, seed)
    ends = matrix.select("part", F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("long"), lambda a, b: a + b)).alias("ends"))
    local = rows.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), F.col("rid")), "rid")))
    sent = local.join(ends, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at"))).cast("int"))
    order = F.xxhash64(F.lit(seed), F.lit("again"), F.col("rid"))
    buckets = max(1, -(-n // n_shards // BUCKET_ROWS))
    sent = sent.withColumn("order", order).withColumn("bucket", F.floor((F.shiftright("order", 1) + F.lit(1 << 62)) / F.lit(float(1 << 63)) * buckets).cast("long"))
    within = sent.withColumn("slot", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("order", "rid")) - 1)
    before = sent.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    placed = within.join(before.drop("n"), ["shard", "bucket"])
    return placed.select(*[F.col("row")[c].alias(c) for c in own], "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"))
