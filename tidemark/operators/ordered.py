"""Ordered window calculations that do not put a partition key into one task.

``Window.partitionBy(key)`` sends every row of a key to one task.  With three order
states, or one source holding a third of the table, that task never ends.  Here the
rows are range-partitioned by (key, order value, tiebreak) into *runs* of about equal
size, whatever the keys look like; windows are evaluated inside each run, and what a
run needs from its neighbours is carried in a table with one row per run:

* totals of the rows of its first key in earlier runs (and of its last key in later
  ones) for running sums, row numbers, ranks and group sizes;
* the same for peers (equal order value) that straddle a boundary;
* a few *ghost* rows copied from the neighbours for lag, lead and ROWS frames.

That table has as many rows as there are runs (``spark.sql.shuffle.partitions``), which
is the bound under which it is broadcast.  The range-partitioned rows are written to the
shared folder first: run numbers must be the same for every reader.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialise

RUN = "__run"
_ALL = "__all"


@dataclass
class Runs:
    """Rows split into ordered runs; see the module text."""

    rows: DataFrame
    part: list[str]
    order: str
    desc: bool
    tie: list[str]
    constant_part: bool

    def _direction(self, name: str, desc: bool) -> Column:
        return F.col(name).desc() if desc else F.col(name).asc()

    def window(self, tie: bool = True) -> WindowSpec:
        keys = [self._direction(self.order, self.desc)]
        if tie:
            keys += [F.col(t).asc() for t in self.tie]
        return self.group().orderBy(*keys)

    def group(self) -> WindowSpec:
        return Window.partitionBy(RUN, *([] if self.constant_part else self.part))

    def key(self) -> Column:
        return F.struct(*[F.col(p) for p in self.part])

    def peer_key(self) -> Column:
        """Key and order value of a row; equal for peers."""
        return F.struct(*[F.col(p) for p in self.part], F.col(self.order).alias("v"))

    def first_and_last(self) -> tuple[Column, Column]:
        """First and last peer of a key in run order.

        Structs compare by value with null smallest and NaN largest, as an ascending order has
        it; a descending one is the reverse, nulls included.
        """
        low, high = F.min(self.peer_key()), F.max(self.peer_key())
        return (high, low) if self.desc else (low, high)

    def finish(self, df: DataFrame) -> DataFrame:
        """Without the columns made here; the caller's own stay, whatever they are called."""
        own = {c for c in self.rows.columns if c not in (RUN, _ALL)}
        return df.drop(*[c for c in df.columns if c.startswith("__") and c not in own])


def split_runs(
    df: DataFrame,
    part: Sequence[str],
    order: str,
    tie: Sequence[str],
    desc: bool = False,
    runs: int | None = None,
) -> Runs:
    """Range-partition the rows into runs and write them.

    Without ``runs`` there are at most ``spark.sql.shuffle.partitions``.  As many as the
    executors can take at once are kept as they are; of more, AQE joins small neighbouring
    ones, so that their number follows the data.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if runs is None and n <= 2 * spark.sparkContext.defaultParallelism:
        runs = n
    constant = not part
    if constant:
        df, part = df.withColumn(_ALL, F.lit(0)), [_ALL]
    keys = [F.col(p).asc() for p in part]
    keys.append(F.col(order).desc() if desc else F.col(order).asc())
    keys += [F.col(t).asc() for t in tie]
    cut = df.repartitionByRange(*([runs] if runs else []), *keys).withColumn(RUN, F.spark_partition_id())
    return Runs(materialise(cut), list(part), order, desc, list(tie), constant)


def _same(a, b) -> bool:
    """Equality of key tuples where NaN equals NaN and null equals null."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _typed(value, kind: T.DataType):
    if isinstance(kind, T.DecimalType):
        return Decimal(value)
    return float(value) if isinstance(kind, T.DoubleType) else value


def _carries(r: Runs, measures: dict[str, Column], peers: bool, dense: bool = False) -> DataFrame:
    """One row per run: what its first and last key (and peers) receive from the neighbours.

    The executors reduce every run to one row; with as many rows as runs, the running sums
    over runs are taken on the driver.  Rows equal to a boundary value are counted only for
    runs whose boundary really falls between equal rows.
    """
    spark = r.rows.sparkSession
    names = list(measures)
    first, last = r.first_and_last()
    per_key = r.rows.groupBy(RUN, *r.part).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(m) for m, c in measures.items()], first.alias("lo"), last.alias("hi")
    )
    edge = F.struct(F.struct(*r.part).alias("k"), F.struct(*names).alias("m"))
    ends = per_key.groupBy(RUN).agg(
        F.min(edge).alias("head"), F.max(edge).alias("tail"), F.min_by("lo", r.key()).alias("hv"), F.max_by("hi", r.key()).alias("tv")
    )
    if dense:
        # distinct values of each key in a run; repeated ones leave a task once
        values = r.rows.select(RUN, *dict.fromkeys([*r.part, r.order])).distinct()
        depth = values.groupBy(RUN, *r.part).agg(F.count(F.lit(1)).alias("d"))
        at = F.struct(F.struct(*r.part).alias("k"), "d")
        sides = depth.groupBy(RUN).agg(F.min(at).alias("x"), F.max(at).alias("y"))
        ends = ends.join(sides.select(RUN, F.col("x.d").alias("hd"), F.col("y.d").alias("d")), RUN)
    schema = ends.schema
    table = sorted(ends.collect(), key=lambda row: row[RUN])
    n = len(table)
    head_key = [tuple(row["head"]["k"]) for row in table]
    tail_key = [tuple(row["tail"]["k"]) for row in table]
    goes_on = [i + 1 < n and _same(tail_key[i], head_key[i + 1]) for i in range(n)]
    equal_on = [peers and i + 1 < n and _same(tuple(table[i]["tv"]), tuple(table[i + 1]["hv"])) for i in range(n)]
    head_peers, tail_peers = _peer_sums(r, measures, table, equal_on) if any(equal_on) else ({}, {})
    before = {m: [0] * n for m in names}
    after = {m: [0] * n for m in names}
    pbefore = {m: [0] * n for m in names}
    pafter = {m: [0] * n for m in names}
    dense_before, dense_after = [0] * n, [0] * n
    for m in names:
        for i in range(1, n):
            if goes_on[i - 1]:
                whole = _same(head_key[i - 1], tail_key[i - 1])
                before[m][i] = table[i - 1]["tail"]["m"][m] + (before[m][i - 1] if whole else 0)
            if equal_on[i - 1]:
                single = _same(tuple(table[i - 1]["hv"]), tuple(table[i - 1]["tv"]))
                pbefore[m][i] = tail_peers[table[i - 1][RUN]][m] + (pbefore[m][i - 1] if single else 0)
        for i in range(n - 2, -1, -1):
            if goes_on[i]:
                whole = _same(head_key[i + 1], tail_key[i + 1])
                after[m][i] = table[i + 1]["head"]["m"][m] + (after[m][i + 1] if whole else 0)
            if equal_on[i]:
                single = _same(tuple(table[i + 1]["hv"]), tuple(table[i + 1]["tv"]))
                pafter[m][i] = head_peers[table[i + 1][RUN]][m] + (pafter[m][i + 1] if single else 0)
    if dense:
        for i in range(1, n):
            if goes_on[i - 1]:
                whole = _same(head_key[i - 1], tail_key[i - 1])
                # a peer group that continues into a run was counted by the run before
                dense_before[i] = table[i - 1]["d"] + (dense_before[i - 1] if whole else 0) - (1 if equal_on[i - 1] else 0)
        for i in range(n - 2, -1, -1):
            if goes_on[i]:
                whole = _same(head_key[i + 1], tail_key[i + 1])
                dense_after[i] = table[i + 1]["hd"] + (dense_after[i + 1] if whole else 0) - (1 if equal_on[i] else 0)
    kind = {m: schema["head"].dataType["m"].dataType[m].dataType for m in names}
    fields = [T.StructField(RUN, schema[RUN].dataType)]
    fields += [T.StructField("__hk", schema["head"].dataType["k"].dataType), T.StructField("__tk", schema["tail"].dataType["k"].dataType)]
    fields += [T.StructField("__hv", schema["hv"].dataType), T.StructField("__tv", schema["tv"].dataType)]
    fields += [T.StructField("__before_d", T.LongType()), T.StructField("__after_d", T.LongType())]
    for m in names:
        fields += [T.StructField(f"__{p}_{m}", kind[m]) for p in ("before", "after", "pbefore", "pafter")]
    out = []
    for i, row in enumerate(table):
        line = [row[RUN], row["head"]["k"], row["tail"]["k"], row["hv"], row["tv"], dense_before[i], dense_after[i]]
        for m in names:
            line += [_typed(v[m][i], kind[m]) for v in (before, after, pbefore, pafter)]
        out.append(tuple(line))
    return spark.createDataFrame(out, T.StructType(fields))


def _peer_sums(r: Runs, measures: dict[str, Column], table, equal_on) -> tuple[dict, dict]:
    """Measures of the rows equal to the first / last value of the runs that share a boundary value."""
    touched = {i for i, e in enumerate(equal_on) if e} | {i + 1 for i, e in enumerate(equal_on) if e}
    key = r.rows.select(r.peer_key().alias("k")).schema["k"].dataType
    fields = [T.StructField(RUN, T.IntegerType()), T.StructField("hv", key), T.StructField("tv", key)]
    spark = r.rows.sparkSession
    bounds = spark.createDataFrame([(table[i][RUN], table[i]["hv"], table[i]["tv"]) for i in sorted(touched)], T.StructType(fields))
    at = r.rows.withColumn("__pk", r.peer_key()).join(F.broadcast(bounds), RUN)
    first, last = F.col("__pk").eqNullSafe(F.col("hv")), F.col("__pk").eqNullSafe(F.col("tv"))
    sums = at.filter(first | last).groupBy(RUN).agg(
        F.struct(*[F.coalesce(F.sum(F.when(first, c)), F.lit(0)).alias(m) for m, c in measures.items()]).alias("h"),
        F.struct(*[F.coalesce(F.sum(F.when(last, c)), F.lit(0)).alias(m) for m, c in measures.items()]).alias("t"),
    )
    rows = sums.collect()  # at most one row per run
    return {x[RUN]: x["h"] for x in rows}, {x[RUN]: x["t"] for x in rows}


def _plus(flag: Column, carried: Column) -> Column:
    return F.when(flag, carried).otherwise(F.lit(0))


def positions(r: Runs, columns: dict[str, str], metric: str | None = None, keep_runs: bool = False) -> DataFrame:
    """Add order statistics over ``part``.

    ``columns`` maps output name to one of: row_number, rank, dense_rank, distinct (order
    values of the group), total (group size), upto (rows at or before, peers included), running_sum (ROWS),
    range_sum (RANGE, peers included), total_sum.  ``keep_runs`` keeps the run column, so
    that :func:`neighbours` can go on with the same runs.
    """
    kinds = set(columns.values())
    measures: dict[str, Column] = {"n": F.lit(1).cast("long")}
    if kinds & {"running_sum", "range_sum", "total_sum"}:
        measures["s"] = F.col(metric)
        measures["c"] = F.when(F.col(metric).isNotNull(), 1).otherwise(0).cast("long")
    need_peers = bool(kinds & {"rank", "dense_rank", "distinct", "upto", "range_sum"})
    carry = _carries(r, measures, need_peers, dense=bool(kinds & {"dense_rank", "distinct"}))
    rows = r.rows
    df = rows.join(F.broadcast(carry), RUN)
    in_head = r.key().eqNullSafe(F.col("__hk"))
    in_tail = r.key().eqNullSafe(F.col("__tk"))
    if "distinct" in kinds:
        df = df.withColumn("__depth", F.dense_rank().over(r.window(tie=False)))
    ordered, peers, group = r.window(), r.window(tie=False), r.group()
    rows_frame = ordered.rowsBetween(Window.unboundedPreceding, 0)

    def summed(window, carried):
        """Sum over a window and what is carried into it; null while no value was seen."""
        seen = F.count(metric).over(window) + carried("c")
        return F.when(seen > 0, F.coalesce(F.sum(metric).over(window), F.lit(0)) + carried("s"))

    made = {}
    for name, kind in columns.items():
        if kind == "row_number":
            c = F.row_number().over(ordered) + _plus(in_head, F.col("__before_n"))
        elif kind == "rank":
            at_head = r.peer_key().eqNullSafe(F.col("__hv"))
            c = F.rank().over(peers) + _plus(in_head, F.col("__before_n")) - _plus(at_head, F.col("__pbefore_n"))
        elif kind == "dense_rank":
            c = F.dense_rank().over(peers) + _plus(in_head, F.col("__before_d"))
        elif kind == "distinct":
            c = F.max("__depth").over(group) + _plus(in_head, F.col("__before_d")) + _plus(in_tail, F.col("__after_d"))
        elif kind == "total":
            c = F.count(F.lit(1)).over(group) + _plus(in_head, F.col("__before_n")) + _plus(in_tail, F.col("__after_n"))
        elif kind == "upto":
            at_tail = r.peer_key().eqNullSafe(F.col("__tv"))
            c = F.count(F.lit(1)).over(peers) + _plus(in_head, F.col("__before_n")) + _plus(at_tail, F.col("__pafter_n"))
        elif kind == "running_sum":
            c = summed(rows_frame, lambda m: _plus(in_head, F.col(f"__before_{m}")))
        elif kind == "range_sum":
            at_tail = r.peer_key().eqNullSafe(F.col("__tv"))
            c = summed(peers, lambda m: _plus(in_head, F.col(f"__before_{m}")) + _plus(at_tail, F.col(f"__pafter_{m}")))
        elif kind == "total_sum":
            c = summed(group, lambda m: _plus(in_head, F.col(f"__before_{m}")) + _plus(in_tail, F.col(f"__after_{m}")))
        else:
            raise ValueError(f"unknown order statistic {kind}")
        made[name] = c
    df = df.withColumns(made)
    return df.select(RUN, *r.rows.drop(RUN).columns, *made) if keep_runs else r.finish(df)


def reversed_positions(r: Runs, part: Sequence[str], columns: dict[str, str], rows: DataFrame | None = None) -> DataFrame:
    """Add order statistics over ``part`` in the opposite direction of runs of the whole table.

    Runs of the whole table are in order for any key: the rows of later runs come first in the
    opposite order.  So a histogram per (run, key) says how many rows of a key come before a run,
    and no row changes its run.  Rows equal to the first or last value of a run may lie in its
    neighbours as well; they are counted by the same histogram.  It is written and joined as its
    size allows; for one key it has at most as many rows as there are runs.

    ``columns`` maps output name to rank, upto (rows at or before, peers included) or total.  A
    null key is a key.  ``rows`` are those of the runs with more columns, as ``keep_runs`` gives them.
    """
    if not r.constant_part:
        raise ValueError("runs of the whole table are needed")
    keys = [f"__p{i}" for i in range(len(part))]
    first, last = r.first_and_last()
    bounds = materialise(r.rows.groupBy(RUN).agg(first.getField("v").alias("__hv"), last.getField("v").alias("__tv")))
    at_head, at_tail = F.col(r.order).eqNullSafe(F.col("__hv")), F.col(r.order).eqNullSafe(F.col("__tv"))
    single = F.col("__hv").eqNullSafe(F.col("__tv"))
    histogram = (
        r.rows.join(F.broadcast(bounds), RUN)
        .groupBy(RUN, "__hv", "__tv", *[F.col(p).alias(k) for p, k in zip(part, keys)])
        .agg(F.count(F.lit(1)).alias("all"), F.count_if(at_head).alias("head"), F.count_if(at_tail).alias("tail"))
    )
    counted = [("all", F.lit(None), F.col("all")), ("head", F.col("__hv"), F.col("head")), ("tail", F.col("__tv"), F.col("tail"))]
    kind = r.rows.schema[r.order].dataType
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), v.cast(kind).alias("v"), n.alias("n")) for side, v, n in counted]))
    # where a run has one value, its head stands for both ends
    sides = histogram.select(RUN, "__hv", "__tv", *keys, sides.alias("s")).filter(~(single & (F.col("s.side") == "tail")))
    over = Window.partitionBy(*keys, F.col("s.side") == "all", "s.v").orderBy(RUN)
    earlier = F.coalesce(F.sum("s.n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.coalesce(F.sum("s.n").over(over.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    sides = sides.withColumns({"earlier": earlier, "later": later})

    def of(side: Column, value: Column) -> Column:
        return F.max(F.when(side, value))

    whole, head, tail = (F.col("s.side") == side for side in ("all", "head", "tail"))
    carried = sides.groupBy(RUN, "__hv", "__tv", *keys).agg(
        of(whole, F.col("later")).alias("__below"),
        of(whole, F.col("earlier") + F.col("s.n") + F.col("later")).alias("__total"),
        of(head, F.col("earlier")).alias("__equal_before"),
        of(tail | (head & single), F.col("later")).alias("__equal_after"),
    )
    carried = materialise(carried.withColumnRenamed(RUN, "__at"))
    rule = F.col(RUN) == F.col("__at")
    for p, k in zip(part, keys):
        rule = rule & F.col(p).eqNullSafe(F.col(k))
    df = (r.rows if rows is None else rows).join(carried, rule)
    opposite = Window.partitionBy(RUN, *part).orderBy(r._direction(r.order, not r.desc))
    made = {
        "rank": F.rank().over(opposite) + F.col("__below") - _plus(at_tail, F.col("__equal_after")),
        "upto": F.count(F.lit(1)).over(opposite) + F.col("__below") + _plus(at_head, F.col("__equal_before")),
        "total": F.col("__total"),
    }
    return r.finish(df.withColumns({name: made[kind] for name, kind in columns.items()}))


def neighbours(r: Runs, columns: dict[str, Callable[[WindowSpec], Column]], back: int = 0, ahead: int = 0) -> DataFrame:
    """Evaluate lag / lead / ROWS-frame expressions that look ``back`` and ``ahead`` rows.

    Each expression receives the ordered window of a run.  The nearest ``back`` (``ahead``)
    rows of the neighbouring runs are copied in as ghosts and removed afterwards.
    """
    rows = r.rows.withColumn("__ghost", F.lit(False))
    fields = [c for c in r.rows.columns if c != RUN]
    pieces = [rows]
    for size, before in ((back, True), (ahead, False)):
        if not size:
            continue
        # the `size` rows of every run nearest to the boundary (at most size per run)
        up = [F.col(p).asc() for p in r.part] + [r._direction(r.order, r.desc)] + [F.col(t).asc() for t in r.tie]
        down = [F.col(p).desc() for p in r.part] + [r._direction(r.order, not r.desc)] + [F.col(t).desc() for t in r.tie]
        near = Window.partitionBy(RUN).orderBy(*(down if before else up))
        edge = r.rows.withColumn("__i", F.row_number().over(near)).filter(F.col("__i") <= size)
        # at most size * runs rows: one ordered task is enough
        seq = Window.orderBy(F.col(RUN) if before else F.desc(RUN), F.desc("__i"))
        first = Window.partitionBy(RUN).orderBy(F.desc("__i"))
        edge = edge.withColumn(
            "__near", F.collect_list(F.struct(*fields)).over(seq.rowsBetween(-size, -1))
        ).withColumn("__first", F.row_number().over(first))
        ghosts = (
            edge.filter(F.col("__first") == 1)
            .select(RUN, F.explode("__near").alias("__g"))
            .select(RUN, *[F.col(f"__g.{c}").alias(c) for c in fields])
            .withColumn("__ghost", F.lit(True))
        )
        pieces.append(ghosts)
    both = pieces[0]
    for extra in pieces[1:]:
        both = both.unionByName(extra)
    w = r.window()
    both = both.withColumns({name: make(w) for name, make in columns.items()})
    return r.finish(both.filter(~F.col("__ghost")))
