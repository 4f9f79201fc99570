"""Row numbers that depend on the data alone, and a keyed permutation of [0, n) in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
MAX_WALKS = 64
BUCKET_ROWS = 50_000
FEWEST_BUCKETS, MOST_BUCKETS = 1 << 12, 1 << 20


def number_rows(df: DataFrame, order: list[Column], spread: list[Column], buckets: int | None = None) -> DataFrame:
    """Add ``_row`` (0 .. n-1 over the whole table) and ``_rows`` (n).

    Rows fall into buckets by the hash of the ``spread`` columns; the bucket
    counts (at most ``MOST_BUCKETS`` rows, hence the broadcast) give each
    bucket its first number and a window inside the bucket gives the rest.
    Unless given, the number of buckets follows from the number of rows.  The
    numbers follow from the rows' values, whatever the partitions are.
    """
    if buckets is None:
        buckets = min(max(df.count() // BUCKET_ROWS, FEWEST_BUCKETS), MOST_BUCKETS)
    b = F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int")
    counts = df.groupBy(b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_first"),
                            F.sum("_c").over(everything).alias("_rows"))
    inside = Window.partitionBy("_b").orderBy(*order)
    return (df.withColumn("_b", b).withColumn("_k", F.row_number().over(inside))
            .join(F.broadcast(offsets), "_b")
            .withColumn("_row", F.col("_first") + F.col("_k") - 1)
            .drop("_b", "_k", "_first"))


def permute(index: Column, n: Column, key: Column) -> Column:
    """Position of ``index`` under a keyed Feistel permutation of [0, n).

    The domain a*b >= n with a = ceil(sqrt(n)), b = ceil(n/a) is less than a
    larger than n.  Six alternating rounds add a keyed hash of one half to the
    other; a result outside [0, n) is permuted again (cycle walking).  The
    walk needs at most a*b-n+1 steps; 64 steps are always enough up to
    n = 4096 and beyond that leave a chance below n**-32, which raises an error.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.greatest(F.ceil(n.cast("double") / a).cast("long"), F.lit(1).cast("long"))
    dims = F.struct(a.alias("a"), b.alias("b"), n.cast("long").alias("n"), key.cast("long").alias("key"),
                    index.cast("long").alias("x"))

    def once(x: Column, d: Column) -> Column:
        start = F.struct((x / d.b).cast("long").alias("l"), (x % d.b).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(
                ((s.l + F.pmod(F.xxhash64(s.r, i, d.key), d.a)) % d.a).alias("l"), s.r.alias("r"))
            ).otherwise(F.struct(
                s.l.alias("l"), ((s.r + F.pmod(F.xxhash64(s.l, i, d.key), d.b)) % d.b).alias("r")))

        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn,
                           lambda s: s.l * d.b + s.r)

    def walk(d: Column) -> Column:
        steps = F.sequence(F.lit(0).cast("long"),
                           F.least(d.a * d.b - d.n, F.lit(MAX_WALKS - 1).cast("long")))
        return F.aggregate(steps, d.x, lambda v, j: F.when((j > 0) & (v < d.n), v).otherwise(once(v, d)))

    out = F.element_at(F.transform(F.array(dims), walk), 1)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def with_permuted(df: DataFrame, out: str, index: Column, n: Column, key: Column) -> DataFrame:
    """Add ``out`` = ``permute(index, n, key)``, its first pass as plain columns.

    Each round is a projection of its own, so the six rounds become generated
    code.  Only rows that the first pass leaves outside [0, n) (less than one
    in sqrt(n)) go on through ``permute``, which walks on from there.
    """
    a = F.greatest(F.ceil(F.sqrt(F.col("_n").cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.greatest(F.ceil(F.col("_n").cast("double") / F.col("_a")).cast("long"), F.lit(1).cast("long"))
    d = df.withColumns({"_n": n.cast("long"), "_key": key.cast("long"), "_x": index.cast("long")}) \
        .withColumn("_a", a).withColumn("_d", b) \
        .withColumns({"_l": ((F.col("_x") - F.col("_x") % F.col("_d")) / F.col("_d")).cast("long"),
                      "_r": F.col("_x") % F.col("_d")})
    for i in range(ROUNDS):
        half, other, size = ("_l", "_r", "_a") if i % 2 == 0 else ("_r", "_l", "_d")
        step = F.pmod(F.xxhash64(other, F.lit(i), "_key"), F.col(size))
        d = d.withColumn(half, (F.col(half) + step) % F.col(size))
    first = F.col("_x")
    return d.withColumn("_x", F.col("_l") * F.col("_d") + F.col("_r")) \
        .withColumn(out, F.when(first < F.col("_n"), first).otherwise(permute(first, F.col("_n"), F.col("_key")))) \
        .drop("_n", "_key", "_x", "_a", "_d", "_l", "_r")
