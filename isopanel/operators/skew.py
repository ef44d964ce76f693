"""Joins of fact rows whose keys may be very uneven.

A lookup that fits a broadcast is joined as it is; no row of the facts moves. For a larger one both sides are shuffled by
key, and a key with a good share of all rows would make one long task. Such keys are found by a sketch of frequent
items, and their rows are spread over salts, to each of which the lookup's few rows for these keys are copied. All other
keys are joined plainly. This doesn't depend on adaptive execution, and the result is that of the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent keys that are looked for at most, and items that the sketch tracks: any key with more than the rows divided by
#: this number is tracked.
FREQUENT, TRACKED = 64, 10_000


def size_in_bytes(df: DataFrame) -> int:
    """The planner's estimate; for files their size, scaled to the columns that are read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """What the session broadcasts at most, in bytes; -1 for nothing."""
    return int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def frequent_keys(facts: DataFrame, key: str, share: float) -> dict[object, int]:
    """Keys that hold more than a share of the rows, with their number of rows, about. Reads the key column once."""
    top = F.expr(f"approx_top_k(`{key}`, {FREQUENT}, {TRACKED})")
    n, found = facts.select(key).where(F.col(key).isNotNull()).agg(F.count(F.lit(1)), top).first()
    return {item["item"]: item["count"] for item in found or () if item["count"] > share * n}


def split_join(
    facts: DataFrame,
    lookup: DataFrame,
    fact_key: str,
    lookup_key: str,
    share: float | None = None,
    broadcastable: bool | None = None,
) -> DataFrame:
    """The inner join of facts with a lookup by one key each, all columns of both. Null keys match nothing.

    A key is frequent if it holds more than ``share`` of the rows, by default what a shuffle partition would hold if rows
    were even. ``broadcastable`` overrides the look at the lookup's size.
    """
    spark = facts.sparkSession
    condition = F.col(fact_key) == F.col(lookup_key)
    if broadcastable is None:
        broadcastable = size_in_bytes(lookup) <= broadcast_limit(lookup)
    if broadcastable:
        return facts.join(lookup, condition)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = 1 / partitions if share is None else share
    heavy = frequent_keys(facts, fact_key, share)
    if not heavy:
        return facts.join(lookup, condition)
    among = F.col(fact_key).isin(list(heavy))
    salts = partitions
    # by the row's own content, so that a task that is run again deals its rows alike
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts))
    salted = facts.where(among).withColumn("_salt", salt)
    copies = lookup.where(F.col(lookup_key).isin(list(heavy))).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    spread = salted.join(copies, condition & (F.col("_salt") == F.col("_copy"))).drop("_salt", "_copy")
    return facts.where(~among).join(lookup, condition).unionByName(spread)
