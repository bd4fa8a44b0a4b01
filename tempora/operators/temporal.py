"""Time travel over a change log (lsn, ts, txn, op, old, new): bags of rows with signs.

A record adds its new row and takes away its old one; a snapshot is the rows whose signs add up to more than nothing, as often as
they add up. Grouping is null-safe and pre-aggregated before the shuffle, so a snapshot costs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signed(log: DataFrame, invert: bool = False) -> DataFrame:
    """(row columns, weight): +1 for each new row, -1 for each old one; inverted for going back."""
    s = -1 if invert else 1
    both = log.select(F.explode(F.array(F.struct(F.col("new").alias("r"), F.lit(s).alias("weight")), F.struct(F.col("old").alias("r"), F.lit(-s).alias("weight")))).alias("x"))
    return both.filter("x.r IS NOT NULL").select("x.r.*", "x.weight")


def collapse(weighted: DataFrame) -> DataFrame:
    """Rows whose weights add up to more than 0, that many times."""
    cols = [c for c in weighted.columns if c != "weight"]
    total = weighted.groupBy(*cols).agg(F.sum("weight").alias("_m")).filter("_m > 0")
    return total.select(*cols, F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_i")).drop("_i")


def snapshot(log: DataFrame, row: T.StructType | None = None) -> DataFrame:
    return collapse(signed(log))


def forward(base: DataFrame, log: DataFrame) -> DataFrame:
    return collapse(base.withColumn("weight", F.lit(1)).unionByName(signed(log)))


def reverse(live: DataFrame, later: DataFrame) -> DataFrame:
    """Live rows without what later records did."""
    return collapse(live.withColumn("weight", F.lit(1)).unionByName(signed(later, True)))


def diff(log: DataFrame, row: T.StructType | None = None) -> DataFrame:
    """(row columns, weight) of what a stretch of the log changed, apart from what it undid itself."""
    w = signed(log)
    cols = [c for c in w.columns if c != "weight"]
    return w.groupBy(*cols).agg(F.sum("weight").alias("weight")).filter("weight <> 0")


def committed(log: DataFrame, txns: DataFrame) -> DataFrame:
    """Records of committed transactions; the list of transactions is joined, not collected."""
    return log.join(txns.select("txn"), "txn", "left_semi")


def latest_by_key(log: DataFrame, key: str) -> DataFrame:
    """The last version of each key that is not deleted; one aggregation, no sort."""
    k = F.coalesce(F.col(f"new.{key}"), F.col(f"old.{key}"))
    last = log.groupBy(k.alias("_k")).agg(F.max_by("new", F.struct("ts", "lsn")).alias("r"))
    return last.filter("r IS NOT NULL").select("r.*")


def strategy(log: DataFrame, us: int, ts: Column | None = None) -> DataFrame:
    """Which way a snapshot is cheaper: the records before and after a time."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) if ts is None else ts
    counts = log.agg(F.count_if(t <= us).alias("n_before"), F.count_if(t > us).alias("n_after"))
    return counts.withColumn("strategy", F.when(F.col("n_before") < F.col("n_after"), "forward").otherwise("reverse"))


def multiset_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def orders_log(orders: DataFrame) -> DataFrame:
    """The change log that the temporal queries use: inserts at the order date, status updates of every seventh order 30 days later,
    deletes of every eleventh another 30 days later; the records of orders divisible by 13 belong to a transaction that aborted."""
    r = F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    u = F.struct("o_orderkey", "o_custkey", F.lit("U").alias("o_orderstatus"), "o_totalprice", "o_orderdate", "o_orderpriority")
    none = F.lit(None).cast(orders.select(r.alias("r")).schema["r"].dataType)
    seventh, eleventh = F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 11 == 0

    def rec(k: int, days: int, op: str, old: Column, new: Column) -> Column:
        return F.struct((F.col("o_orderkey") * 4 + k).alias("lsn"), (F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"), (F.col("o_orderkey") % 100).alias("txn"), F.lit(op).alias("op"), old.alias("old"), new.alias("new"))

    current = F.when(seventh, u).otherwise(r)
    recs = F.array_compact(F.array(rec(0, 0, "I", none, r), F.when(seventh, rec(1, 30, "U", r, u)), F.when(eleventh, rec(2, 60, "D", current, none))))
    return orders.select(F.explode(recs).alias("x")).select("x.*")
