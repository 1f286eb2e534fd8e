"""Exact percentiles by radix selection.

Every double has an order-preserving 64 bit image. A pass counts the values by the leading bits of their images, which
finds, for every wanted rank, the bucket that holds it; the next pass counts the following bits inside those buckets
only. A bucket of one distinct value ends the search for its ranks: for values on a grid (whole milliseconds or beats)
one scan is enough, for any others four passes exhaust the 64 bits. Counting is combined map-side and a pass returns at
most 2^16 buckets (2^22 in the first, of which values of one magnitude touch some thousands) for a group, so neither a
hot group, nor a hot value, nor very many distinct values meet in one task. Ranks are interpolated linearly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoqt.functions.formulas import col
from isoqt.session import BROADCAST_ROW_LIMIT, settle

#: Leading bits of the first pass (sign, exponent, ten bits of the fraction) and of each further one.
FIRST_BITS, STEP_BITS = 22, 16
#: Buckets of at most so many rows are counted by value at once, in place of further passes over leading bits.
FEW = 1 << 16


def ordered_image(value: Column) -> Column:
    """A bigint that orders as the double does; equal doubles have equal images. Null for null and NaN."""
    size = F.abs(value)
    power = lambda e: F.pow(F.lit(2.0), e)  # noqa: E731  exact for whole exponents
    rough = F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-1022.0))
    off = F.when(size / power(F.least(rough, F.lit(1023.0))) >= 2, 1.0).when(size / power(rough) < 1, -1.0).otherwise(0.0)
    exponent = F.least(F.greatest(rough + off, F.lit(-1022.0)), F.lit(1023.0))
    bits = (exponent + 1022).cast("bigint") * F.lit(1 << 52) + (size / power(exponent) * float(1 << 52)).cast("bigint")
    top = F.lit((1 << 62) - 1 + (1 << 62))
    whole = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), top).otherwise(bits)
    return F.when(value.isNotNull() & ~F.isnan(value), F.when(value < 0, -whole).otherwise(whole))


def same_keys(keys) -> Column:
    """Null-safe equality of ``keys`` with their ``__`` namesakes."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])


def percentiles(df: DataFrame, wanted: dict, by=()) -> DataFrame:
    """One row per group with a column per wanted percentile.

    ``wanted`` maps an output name to (value column, probability). Nulls and NaN are no values. Each pass is run here and
    leaves one settled row for each group and rank; the buckets still open are broadcast only if few, else joined.
    """
    by = list(by)
    sources: dict[str, Column] = {}
    probes = []
    for value, p in wanted.values():
        key = str(value)
        sources.setdefault(key, col(value))
        probes.append((list(sources).index(key), float(p)))
    structs = [F.struct(F.lit(i).alias("vi"), c.cast("double").alias("v")) for i, c in enumerate(sources.values())]
    rows = df.select(*by, F.explode(F.array(*structs)).alias("s")).select(*by, "s.vi", "s.v")
    rows = rows.filter(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("image", ordered_image(F.col("v")))
    group = [*by, "vi"]
    counts = [F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")]

    # Pass 1: leading bits. Every rank (the two around each probability) finds its bucket.
    shift = 64 - FIRST_BITS
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = (rows.groupBy(*group, F.shiftright("image", shift).alias("bucket")).agg(*counts)
            .withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(Window.partitionBy(*group))))
    table = F.array(*[F.struct(F.lit(i).alias("pi"), F.lit(vi).alias("pvi"), F.lit(p).alias("p")) for i, (vi, p) in enumerate(probes)])
    at = F.col("probe.p") * (F.col("total") - 1)
    ranks = F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("side"), F.least(F.floor(at) + 1, F.col("total") - 1).alias("rank")))
    probed = (hist.withColumn("probe", F.explode(F.filter(table, lambda t: t["pvi"] == F.col("vi")))).withColumn("part", at - F.floor(at))
              .withColumn("r", F.explode(ranks)).select("*", "r.side", "r.rank", "probe.pi"))
    columns = [*group, "pi", "side", "rank", "part", "bucket", "base", "n", "least", "most"]
    inside = (F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto"))
    found = settle(probed.filter(inside).withColumn("base", F.col("upto") - F.col("n")).select(*columns))
    done = [found.filter("least = most")]

    while shift > 0:
        todo = found.filter("least < most")
        left = todo.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).first()
        if not left["rows"]:
            break
        # The next bits inside the open buckets; small ones are counted by value.
        step = 0 if left["n"] <= FEW else max(0, shift - STEP_BITS)
        keys = [*group, "bucket"]
        targets = todo.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        targets = F.broadcast(targets) if left["rows"] <= BROADCAST_ROW_LIMIT else targets
        within = rows.withColumn("bucket", F.shiftright("image", shift)).join(targets, same_keys(keys)).drop(*[f"__{k}" for k in keys])
        running = Window.partitionBy(*keys).orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
        finer = within.groupBy(*keys, F.shiftright("image", step).alias("next")).agg(*counts).withColumn("upto", F.sum("n").over(running))
        asked = todo.select(*[F.col(k).alias(f"__{k}") for k in keys], "pi", "side", "rank", "part", "base")
        hit = (F.col("rank") - F.col("base") >= F.col("upto") - F.col("n")) & (F.col("rank") - F.col("base") < F.col("upto"))
        found = settle(finer.join(asked, same_keys(keys)).filter(hit).withColumn("base", F.col("base") + F.col("upto") - F.col("n"))
                       .drop("bucket").withColumnRenamed("next", "bucket").select(*columns))
        done.append(found if step == 0 else found.filter("least = most"))
        shift = step

    ends = reduce(DataFrame.unionByName, done).groupBy(*by, "pi").agg(
        F.max(F.when(F.col("side") == 0, F.col("least"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("least"))).alias("high"), F.max("part").alias("part"))
    # equal ends give exactly their value
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part"))
    wide = ends.select(*by, "pi", value.alias("q")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("pi", "q"))).alias("qs"))
    return wide.select(*by, *[F.try_element_at("qs", F.lit(i)).alias(name) for i, name in enumerate(wanted)])


def join_groups(left: DataFrame, right: DataFrame, by, how: str = "left") -> DataFrame:
    """Attach per-group results to another per-group table; groups may be null."""
    by = list(by)
    if not by:  # two one-row tables
        return left.withColumn("__one", F.lit(1)).join(
            right.withColumn("__one", F.lit(1)), "__one", how).drop("__one")
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in by],
                           *[c for c in right.columns if c not in by])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in by])
