"""Uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, as one table of the joint
distribution that a uniform random permutation of all rows would give: each partition's row of
the matrix is multivariate hypergeometric given what the partitions before it have taken.  Then
every partition permutes its own rows and deals them out by its counts, the rows are exchanged,
and each shard permutes what it has received.  Shard sizes differ by one at most, by
construction; no row's place depends on a global sort.

The matrix is drawn in two levels, so that nothing is sequential in the number of partitions:
first for blocks of BLOCK partitions, then within each block for its partitions (a block's
counts are split among its partitions by the same law).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, let
from tidemark.operators.support import attach
from tidemark.session import materialise

#: Partitions of one block of the matrix; a task holds one block's rows of the matrix.
BLOCK = 512
#: Rows that the second permutation sorts in one task, about.
RUN = 200_000


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on ``parts`` only, so a repeated task draws the same."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(u: Column, good: Column, bad: Column, n: Column) -> Column:
    """How many of ``n`` draws without replacement from ``good + bad`` are good, by inversion of ``u``.

    The weights follow from each other by a ratio, so no factorials are needed.  They are summed
    over nine standard deviations and twelve values either way from the mode; what lies beyond
    is smaller than the rounding of doubles.
    """

    def bounds() -> Column:
        total = good + bad
        mode = F.floor((n + 1.0) * (good + 1.0) / (total + 2.0))
        spread = F.sqrt(n * (good / total) * (bad / total) * (total - n) / F.greatest(total - 1.0, F.lit(1.0)))
        reach = F.ceil(spread * 9.0) + 12
        low, high = F.greatest(n - bad, F.lit(0.0)), F.least(good, n)
        return F.struct(
            F.greatest(low, mode - reach).cast("long").alias("a"), F.greatest(low, F.least(high, mode + reach)).cast("long").alias("b")
        )

    def ratio(k: Column) -> Column:
        k = k.cast("double")
        return (good - k) * (n - k) / ((k + 1.0) * (bad - n + k + 1.0))

    def walk(b: Column) -> Column:
        values = F.sequence(b["a"], b["b"])
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        total = F.aggregate(
            values, start, lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"]
        )

        def found(goal: Column) -> Column:
            first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), b["a"].alias("at"))
            step = lambda s, k: F.struct(
                (s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum"), F.when(s["sum"] <= goal, k).otherwise(s["at"]).alias("at")
            )
            return F.aggregate(values, first, step, lambda s: s["at"])

        return let(total * u, found)

    return F.when((n <= 0) | (good <= 0), F.lit(0).cast("long")).when(bad <= 0, n.cast("long")).otherwise(let(bounds(), walk))


def matrix_rows(members: Column, capacity: Column, shards: int, *seed: Column) -> Column:
    """For each ``(part, n)`` of ``members`` in turn, how many of its rows go to each shard.

    ``capacity`` is what the shards take from all members together; the last member gets what
    is left.  Returns an array of ``(part, counts)``.
    """

    def one(n: Column, part: Column, caps: Column) -> Column:
        def step(s: Column, j: Column) -> Column:
            cap = F.get(caps, j)
            drawn = hypergeometric(
                uniform(*seed, part, j), cap.cast("double"), (s["pool"] - cap).cast("double"), s["left"].cast("double")
            )
            return let(
                drawn,
                lambda d: F.struct((s["left"] - d).alias("left"), (s["pool"] - cap).alias("pool"), F.array_append(s["out"], d).alias("out")),
            )

        pool = F.aggregate(caps, F.lit(0).cast("long"), lambda a, c: a + c)
        start = F.struct(n.alias("left"), pool.alias("pool"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step, lambda s: s["out"])

    def member(s: Column, m: Column) -> Column:
        return let(
            one(m["n"], m["part"], s["caps"]),
            lambda counts: F.struct(
                F.zip_with(s["caps"], counts, lambda a, b: a - b).alias("caps"),
                F.array_append(s["rows"], F.struct(m["part"].alias("part"), counts.alias("counts"))).alias("rows"),
            ),
        )

    empty = F.array().cast("array<struct<part:bigint,counts:array<bigint>>>")
    return F.aggregate(members, F.struct(capacity.alias("caps"), empty.alias("rows")), member, lambda s: s["rows"])


def communication_matrix(sizes: DataFrame, capacities: list[int], seed: int) -> DataFrame:
    """``(part, counts)`` for ``sizes (part, n)``: row sums are ``n``, column sums the capacities."""
    shards = len(capacities)
    caps = F.array(*[F.lit(c).cast("long") for c in capacities])
    blocks = sizes.withColumn("block", F.floor(F.col("part") / BLOCK)).groupBy("block").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "n"))).alias("members")
    )
    upper = blocks.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("block").alias("part"), "n"))).alias("all"))
    drawn = upper.select(F.explode(matrix_rows(F.col("all"), caps, shards, F.lit(seed), F.lit("block"))).alias("r"))
    drawn = drawn.select(F.col("r.part").alias("block"), F.col("r.counts").alias("caps"))
    rows = blocks.join(drawn, "block").select(
        F.explode(matrix_rows(F.col("members"), F.col("caps"), shards, F.lit(seed), F.lit("part"))).alias("r")
    )
    return rows.select("r.part", "r.counts")


def hypergeometric_shards(rows: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0): a uniform shuffle of all rows.

    Shard sizes differ by one at most (the first ones are larger).  Every row counts, also nulls
    and repeated rows: rows are told apart by their place in the input, which is written once
    with the rows, so a lost executor cannot change it.  An empty table gives an empty result;
    columns named ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = rows.drop("shard", "slot")
    own = rows.columns
    part, place, rank, counts, run, base, mix = fresh(rows, "part", "place", "rank", "counts", "run", "base", "mix")
    placed = materialise(
        rows.withColumn(part, F.spark_partition_id().cast("long")).withColumn(place, F.monotonically_increasing_id())
    )
    sizes = materialise(placed.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    capacities = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix(sizes, capacities, seed).select(F.col("part").alias(part), F.col("counts").alias(counts))

    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), F.lit("local"), F.col(place)), F.col(place))
    bits = max(0, (total // shards // RUN).bit_length())
    dealt = (
        attach(placed.withColumn(rank, F.row_number().over(local) - 1), matrix, part)
        .withColumn(
            "shard",
            F.aggregate(
                counts,
                F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at")),
                lambda s, c: F.struct((s["sum"] + c).alias("sum"), (s["at"] + (s["sum"] + c <= F.col(rank)).cast("int")).alias("at")),
                lambda s: s["at"],
            ),
        )
        .withColumn(mix, F.xxhash64(F.lit(seed), F.lit("shard"), F.col(place)))
        # the second permutation orders a shard by this hash; its leading bits name the run
        .withColumn(run, F.shiftrightunsigned(mix, 64 - bits) if bits else F.lit(0).cast("long"))
    )
    dealt = materialise(dealt.select(*own, "shard", run, mix, place))
    before = Window.partitionBy("shard").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("shard", run).agg(F.count(F.lit(1)).alias(base))
    runs = runs.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    within = Window.partitionBy("shard", run).orderBy(mix, place)
    out = attach(dealt.withColumn("slot", F.row_number().over(within) - 1), runs, ["shard", run])
    return out.select(*[F.col(f"`{c}`") for c in own], "shard", (F.col("slot") + F.col(base)).cast("long").alias("slot"))
