"""Exact medians over groups of any size.

``percentile`` keeps a map of all distinct values of a group in the memory of one task. That is right for small
groups and wrong when one year or one place holds a third of all rows. Here the rows are read at most twice, whatever
their values:

1. The first pass makes a quantile sketch for each group, in every task before anything is shuffled. A group of up to
   ``SKETCH`` rows is held whole by its sketch, which then knows the exact median. Of a larger one it knows two values
   with the median between them, almost surely, and few rows beside it. Sketches can be merged, so medians of coarser
   groups start from the same pass.
2. For the larger groups the second pass counts the rows below the bracket and the distinct values within it, again
   before the shuffle. The counts prove that the middle rows are inside, and the median is read off their order.

A group whose proof fails is done by counts of all its values. A bracket with more than ``FEW`` distinct values, or such
a group, is narrowed down: the range is cut into a bounded number of slabs, counts are summed by slab, and the running
sum names those that hold the middle rows. This is repeated on their range; wide ranges are cut by the logarithm and
narrow ones evenly, so each level leaves about a thousandth of it, and a handful of levels does for any doubles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.tables import store

#: Values that a sketch keeps about, and the share of a group's rows on either side of the middle that is bracketed. It
#: is over three times the error of such a sketch's ranks.
SKETCH, MARGIN = 4_096, 0.0025
#: Slabs that a group's range is cut into, and distinct values of a group that are sorted without cutting.
SLABS, FEW = 1_024, 1 << 17
#: Powers of two above which a range is cut by the logarithm.
WIDE = 2.0

_ABOVE_DEPTH = 1100.0  # more than 1074, the depth of the smallest double, so that depths of positives are > 0
_INF = float("inf")
_UPPER = 1e-6  # beyond one half: the rank of the upper middle row of up to SKETCH rows


def value_counts(df: DataFrame, keys: Sequence[str], value: str = "value", count: str = "n") -> DataFrame:
    """Distinct non-missing values per group with their number of rows. Rows with a null key are dropped."""
    present = [F.col(k).isNotNull() for k in keys] + [F.col(value).isNotNull(), ~F.isnan(F.col(value))]
    kept = df.where(_all(present)).withColumn(value, F.col(value).cast("double"))
    return kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count))


class Sketches:
    """Rows and the sketches of their groups, from which exact medians of these or of coarser groups are taken.

    ``states`` is stored: keys, number of rows, their sum, and a sketch of the values. Rows with a missing key or value
    don't count. The rows are read again only where a group is larger than a sketch. ``of`` is a condition on the keys:
    medians of the sketches' own groups will be asked for where it holds.
    """

    def __init__(
        self,
        rows: DataFrame,
        keys: Sequence[str],
        value: str = "value",
        size: int = SKETCH,
        margin: float = MARGIN,
        of: Column | None = None,
    ) -> None:
        self.keys, self.size, self.margin = list(keys), size, margin
        self.of = F.lit(True) if of is None else of
        present = [F.col(k).isNotNull() for k in self.keys] + [F.col(value).isNotNull(), ~F.isnan(F.col(value))]
        self.rows = rows.where(_all(present)).select(*self.keys, F.col(value).cast("double").alias("_v"))
        states = self.rows.groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_v").alias("_sum"),
            F.kll_sketch_agg_double("_v", F.lit(size)).alias("_sketch"),
        )
        self.states = store(states, "sketches")
        self.largest = self.states.where(self.of).agg(F.max("_n")).first()[0] or 0

    def sums(self, output: str = "sum") -> DataFrame:
        """The sum of each group's values."""
        return self.states.select(*self.keys, F.col("_sum").alias(output))

    def median(self, keys: Sequence[str] | None = None, output: str = "median", few: int = FEW) -> DataFrame:
        """The median of each group; with ``keys``, a part of the sketches' own, that of the coarser groups."""
        middle = [F.kll_sketch_get_quantile_double("_sketch", F.lit(rank)) for rank in (0.5, 0.5 + _UPPER)]
        ends = [F.kll_sketch_get_quantile_double("_sketch", F.lit(0.5 + x * self.margin)) for x in (-1, 1)]
        read_off = ((middle[0] + middle[1]) / 2).alias("_median"), ends[0].alias("_lo"), ends[1].alias("_hi")
        if keys is None:
            keys, largest = self.keys, self.largest
            groups = self.states.where(self.of).select(*keys, "_n", *read_off)
        else:
            keys = list(keys)
            merged = self.states.groupBy(*keys).agg(
                F.sum("_n").alias("_n"), F.kll_merge_agg_double("_sketch", F.lit(self.size)).alias("_sketch")
            )
            # merging draws at random; stored, all tasks of the second pass see the same brackets
            groups = store(merged.select(*keys, "_n", *read_off), "brackets")
            largest = groups.agg(F.max("_n")).first()[0] or 0
        small = groups.where(F.col("_n") <= self.size).select(*keys, F.col("_median").alias(output))
        if largest <= self.size:
            return small
        large = groups.where(F.col("_n") > self.size).withColumnRenamed("_n", "_total")
        return small.unionByName(self._counted(large.drop("_median"), keys, few, output))

    def _counted(self, large: DataFrame, keys: list[str], few: int, output: str) -> DataFrame:
        """Medians of groups that are larger than a sketch, by counting the rows below and within their brackets."""
        value = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))  # null below the bracket
        counted = self.rows.join(large, keys).where("_v <= _hi").groupBy(*keys, value.alias("_v")).agg(
            F.first("_total").alias("_total"), F.count(F.lit(1)).alias("_n")
        )
        counts = store(counted, "bracketed")
        inside = F.col("_v").isNotNull()
        groups = counts.groupBy(*keys).agg(
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            F.count("_v").alias("_k"),
            F.first("_total").alias("_total"),
            F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("_below"),
            F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("_inside"),
            F.lit(False).alias("_found"),
        )
        proven = (F.col("_below") < _lower()) & (F.col("_below") + F.col("_inside") >= _upper())
        failed, most = groups.agg(F.count(F.when(~proven, 1)), F.max(F.when(proven, F.col("_k")))).first()
        within = counts.where(inside).drop("_total")
        result = _median_within(within, groups.where(proven).drop("_inside"), keys, few, output, (most or 0) > few)
        if failed:
            again = store(groups.where(~proven).select(*keys), "failed")
            counts = self.rows.join(again, keys, "left_semi").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
            result = result.unionByName(_median_of_counts(store(counts, "counts"), keys, few, output))
        return result


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    output: str = "median",
    weight: str | None = None,
    few: int = FEW,
    size: int = SKETCH,
    margin: float = MARGIN,
) -> DataFrame:
    """Median of ``value`` per group; the mean of the middle two when the number of rows is even.

    With ``weight`` each row stands for that many equal rows, so the result of :func:`value_counts` on finer keys can be
    rolled up without reading the rows again. Sketches or counts are made here; what is read off them is left to the
    plan that is returned.
    """
    keys = list(keys)
    if weight is None:
        return Sketches(df, keys, value, size, margin).median(output=output, few=few)
    present = df.where(_all([F.col(k).isNotNull() for k in keys]))
    counts = store(present.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(weight).alias("_n")), "counts")
    return _median_of_counts(counts, keys, few, output)


def _median_of_counts(counts: DataFrame, keys: list[str], few: int, output: str) -> DataFrame:
    """Medians from stored counts ``_n`` of all distinct values ``_v``."""
    groups = counts.groupBy(*keys).agg(
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.count(F.lit(1)).alias("_k"),
        F.sum("_n").alias("_total"),
        F.lit(0).cast("bigint").alias("_below"),
        F.lit(False).alias("_found"),
    )
    most = groups.agg(F.max("_k")).first()[0] or 0
    return _median_within(counts, groups, keys, few, output, most > few)


def _median_within(
    counts: DataFrame, groups: DataFrame, keys: list[str], few: int, output: str, narrow: bool
) -> DataFrame:
    """Medians of groups from the counts within their ranges, which are narrowed first where they hold many values."""
    many, open_groups, found = (F.col("_k") > few) & ~F.col("_found"), groups, None
    while narrow:
        groups = store(groups.where(~many).unionByName(_narrow(counts, groups.where(many), keys)), "groups")
        narrow = not groups.where(many).isEmpty()
        open_groups = groups.where(~F.col("_found"))
        found = groups.where("_found").select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(output))
    within = counts.join(open_groups, keys).where("_v >= _lo and _v <= _hi")
    before = F.col("_below") + _running("_n", Window.partitionBy(*keys).orderBy("_v"))
    middle = within.withColumn("_before", before).where(_holds_middle(F.col("_before"), F.col("_n")))
    # One or two values per group are left. Halving the sum, not summing the halves, is how a mean of two is taken.
    sorted_out = middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(output))
    return sorted_out if found is None else sorted_out.unionByName(found)


def small_group_median(value: str | Column) -> Column:
    """Aggregate for groups whose size is bounded by the domain, such as the years of one series."""
    return F.percentile(value, F.lit(0.5))


def _narrow(counts: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The groups with the ranges of the slabs that hold their middle rows.

    If the middle rows lie in two slabs, they are the highest value of the one and the lowest of the other, and found.
    """
    ranges = groups.drop("_k", "_found")
    within = counts.join(ranges, keys).where("_v >= _lo and _v <= _hi")
    slabs = (
        within.withColumn("_slab", _slab(F.col("_v"), F.col("_lo"), F.col("_hi")))
        .groupBy(*keys, "_total", "_below", "_slab")
        .agg(F.sum("_n").alias("_m"), F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    placed = slabs.withColumn("_below", F.col("_below") + _running("_m", Window.partitionBy(*keys).orderBy("_slab")))
    middle = placed.where(_holds_middle(F.col("_below"), F.col("_m")))
    several = F.count(F.lit(1)) > 1
    return middle.groupBy(*keys).agg(
        F.when(several, F.min("_hi")).otherwise(F.min("_lo")).alias("_lo"),
        F.when(several, F.max("_lo")).otherwise(F.max("_hi")).alias("_hi"),
        F.sum("_k").alias("_k"),
        F.first("_total").alias("_total"),
        F.min("_below").alias("_below"),
        several.alias("_found"),
    )


def _running(count: str, window) -> Column:
    return F.coalesce(F.sum(count).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _holds_middle(before: Column, size: Column) -> Column:
    """True when rows ``before+1 .. before+size`` include one of the two middle rows of ``_total``."""
    return (before < _upper()) & (before + size >= _lower())


def _lower() -> Column:
    return F.expr("(_total + 1) div 2")


def _upper() -> Column:
    return F.expr("_total div 2 + 1")


def _depth(v: Column) -> Column:
    """The binary logarithm of the distance from zero, signed and finite, so that it never falls as the value rises."""
    depth = F.log2(F.abs(v)) + _ABOVE_DEPTH
    return (
        F.when(v == 0, 0.0)
        .when(F.abs(v) == _INF, F.when(v > 0, 2 * _ABOVE_DEPTH).otherwise(-2 * _ABOVE_DEPTH))
        .when(v > 0, depth)
        .otherwise(-depth)
    )


def _slab(v: Column, lo: Column, hi: Column) -> Column:
    """The number of a value's slab. It never falls as the value rises, and the ends of a range lie in different ones."""
    wide = _depth(hi) - _depth(lo) > WIDE
    by_depth = (_depth(v) - _depth(lo)) / (_depth(hi) - _depth(lo))
    evenly = (v - lo) / (hi - lo)
    return F.least(F.floor(F.when(wide, by_depth).otherwise(evenly) * SLABS), F.lit(SLABS - 1)).cast("int")


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
