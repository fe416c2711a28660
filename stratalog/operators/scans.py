"""Running sums, numbers and order statistics of tables too large for one task.

A scan sorts by ranges, sums each range by itself, and adds to a range what the ranges before
it have: only a row for each range (and key in it) is summed up in one place. Order statistics
are narrowed down between approximate quantiles whose ranks are counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.sources.writers import shared_folder

#: Ranges between approximate quantiles that a round of selection counts, and values of a
#: group that are few enough to be looked at together.
RANGES, FEW = 64, 10_000


def kept(rows: DataFrame, kind: str) -> DataFrame:
    """rows from a table in the shared folder: what comes after does not run them again, and a
    lost executor costs no more than its own part."""
    path = shared_folder(rows.sparkSession, kind)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def scan(
    rows: DataFrame, order: Sequence[str | Column], sums: dict[str, str | Column] | None = None, keys: Sequence[str] = (),
    number: str | None = None, previous: dict[str, str] | None = None,
) -> DataFrame:
    """rows with running totals in the given order, of all rows or by key.

    sums: names of new columns and what they add up, the own row included; number: name of a
    column with the row's number from 0; previous: names of new columns and the columns whose
    value in the row before they have, null in the first. Rows tied in the order come in some
    order that is the same throughout. Rows with a null key come back without totals' meaning
    changed for others; rows are none where rows has none.
    """
    keys, sums, previous = list(keys), dict(sums or {}), dict(previous or {})
    if number:
        sums[number] = F.lit(1).cast("long")
    added = [f"_add{i}" for i in range(len(sums))]
    valued = rows.select("*", *(_col(v).alias(a) for v, a in zip(sums.values(), added)), F.monotonically_increasing_id().alias("_scan_tie"))
    by = [*keys, *order, "_scan_tie"]
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_ = valued.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = kept(sorted_.select("*", F.spark_partition_id().alias("_scan_part"), nth.alias("_scan_nth")).drop("_scan_tie"), "scan")

    inside = Window.partitionBy(*keys, "_scan_part").orderBy("_scan_nth")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "*", *(F.sum(a).over(upto).alias(f"_in{i}") for i, a in enumerate(added)),
        *(F.lag(c).over(inside).alias(f"_lag{i}") for i, c in enumerate(previous.values())), F.row_number().over(inside).alias("_scan_at"),
    )
    last = [F.max_by(c, "_scan_nth").alias(f"_last{i}") for i, c in enumerate(previous.values())]
    totals = placed.groupBy(*keys, "_scan_part").agg(F.count("*").alias("_scan_n"), *(F.sum(a).alias(f"_sum{i}") for i, a in enumerate(added)), *last)
    before = _before(totals, keys, len(sums), len(previous))
    joined = local.join(before, [*keys, "_scan_part"])
    out = {name: F.coalesce(f"_before{i}", F.lit(0)) + F.col(f"_in{i}") for i, name in enumerate(sums)}
    if number:
        out[number] = out[number] - 1
    out |= {name: F.when(F.col("_scan_at") > 1, F.col(f"_lag{i}")).otherwise(F.col(f"_edge{i}")) for i, name in enumerate(previous)}
    return joined.withColumns(out).select(*rows.columns, *out)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _before(totals: DataFrame, keys: list[str], n_sums: int, n_previous: int) -> DataFrame:
    """(keys, _scan_part, _before.., _edge..): the sums of the ranges before each, and the last values
    there. Without keys there is a row for each range, whose sums the driver adds up."""
    if keys:
        over = Window.partitionBy(*keys).orderBy("_scan_part")
        so_far = over.rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *keys, "_scan_part", *(F.sum(f"_sum{i}").over(so_far).alias(f"_before{i}") for i in range(n_sums)),
            *(F.lag(f"_last{i}").over(over).alias(f"_edge{i}") for i in range(n_previous)),
        )
    sums, edges, out = [None] * n_sums, [None] * n_previous, []
    for row in sorted(totals.collect(), key=lambda r: r["_scan_part"]):
        out.append((row["_scan_part"], *sums, *edges))
        add = lambda a, b: b if a is None else a if b is None else a + b
        sums = [add(a, row[f"_sum{i}"]) for i, a in enumerate(sums)]
        edges = [row[f"_last{i}"] for i in range(n_previous)]
    kinds = dict(totals.dtypes)
    schema = ", ".join(["_scan_part int", *(f"_before{i} {kinds[f'_sum{i}']}" for i in range(n_sums)), *(f"_edge{i} {kinds[f'_last{i}']}" for i in range(n_previous))])
    return F.broadcast(totals.sparkSession.createDataFrame(out, schema))


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with their number from 0 in the given order, of all rows or by key."""
    return scan(rows, order, keys=keys, number=name)


def order_statistics(rows: DataFrame, group: str, value: str, ranks: DataFrame) -> DataFrame:
    """ranks(group, rank) with value, that of the rank, from 0, among the values of the group.

    A round counts the values of each group between some approximate quantiles of those still
    in question, and goes on with those between two; when they are few or equal, the value
    is looked up. Memory is that of the quantiles' sketch and of FEW values a rank; a round
    reads the values once and leaves about one in RANGES of them.
    """
    values = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    asked = ranks.select(F.col(group).alias("g"), F.col("rank").cast("long").alias("rank")).distinct()
    ends = values.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    state = kept(_meet(asked, ends, ["g"]).select("g", "rank", F.col("rank").alias("left"), "low", "high", "n"), "ranks")
    settled = []
    while True:
        done = (F.col("low") == F.col("high")) | (F.col("n") <= FEW)
        settled.append(state.where(done))
        state = state.where(~done)
        if state.isEmpty():
            break
        near = _within(values, state)
        shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
        cuts = near.groupBy("g", "rank").agg(F.array_distinct(F.percentile_approx("v", shares, F.lit(10_000))).alias("cuts"))
        # a cut is a range of its own, so that the last range of equal values is told from its neighbours
        side = F.aggregate("cuts", F.lit(0), lambda k, c: k + (F.col("v") >= c).cast("int") + (F.col("v") > c).cast("int"))
        cut = _meet(near, cuts, ["g", "rank"]).select("g", "rank", "left", "v", side.alias("side"))
        counted = cut.groupBy("g", "rank", "left", "side").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("g", "rank").orderBy("side").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("below", below).where("below <= left AND left < below + n")
        state = kept(found.select("g", "rank", (F.col("left") - F.col("below")).alias("left"), "low", "high", "n"), "ranks")
    last = kept(reduce(DataFrame.unionByName, settled), "ranks")
    same = last.where("low = high").select("g", "rank", F.col("low").alias("value"))
    few = _within(values, last.where("low < high")).groupBy("g", "rank", "left").agg(F.array_sort(F.collect_list("v")).alias("v"))
    found = same.unionByName(few.select("g", "rank", F.get("v", F.col("left").cast("int")).alias("value")))
    return found.select(F.col("g").alias(group), "rank", "value")


def _within(values: DataFrame, state: DataFrame) -> DataFrame:
    """(g, rank, left, v): the values that each rank in question may be, once for each."""
    return _meet(values, state.select("g", "rank", "left", "low", "high"), ["g"]).where("v BETWEEN low AND high").select("g", "rank", "left", "v")


def _meet(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The inner join in which nulls are equal."""
    other = b.withColumnsRenamed({c: f"_{c}" for c in on})
    return a.join(other, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on))).drop(*(f"_{c}" for c in on))


def quantiles(rows: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(group, share, value): exact quantiles by group, between two values linearly."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    share = F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share")
    at = n.select(group, "n", share).withColumn("at", F.col("share") * (F.col("n") - 1))
    at = kept(at.select(group, "share", "at", F.floor("at").alias("low"), F.ceil("at").alias("high")), "shares")
    ranks = at.select(group, F.col("low").alias("rank")).union(at.select(group, "high")).distinct()
    found = kept(order_statistics(rows, group, value, ranks), "quantiles")
    low, high = (found.select(group, F.col("rank").alias(r), F.col("value").alias(v)) for r, v in (("low", "va"), ("high", "vb")))
    both = _meet(_meet(at, low, [group, "low"]), high, [group, "high"])
    return both.select(group, "share", (F.col("va") + (F.col("at") - F.col("low")) * (F.col("vb") - F.col("va"))).alias("value"))
