"""Every registered query with the SQL that gives the same rows. Relational ones are dialect text, in either vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.dialect.parser import parse
from tempora.functions import scalar
from tempora.operators import analytics as an
from tempora.operators import constraints as ct
from tempora.operators import learning
from tempora.operators import temporal as tt
from tempora.plans.lower import lower
from tempora.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _dialect(name: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, d, text=text: lower(parse(text), lambda t: table(spark, d, t))
    ORACLES[name] = oracle


def _query(name: str, oracle: str):
    def put(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return put


# ---- scan, projection, filters

_dialect("scan_all", "SELECT * FROM customer;", "SELECT * FROM customer")
_dialect("project_cols", "2E5TAR n_name, n_regionkey MEN nation;", "SELECT n_name, n_regionkey FROM nation")
_dialect("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77;", "SELECT * FROM orders WHERE o_orderkey = 77")
_dialect("row_count", "SELECT COUNT(*) AS n FROM lineitem;", "SELECT count(*) AS n FROM lineitem")
_dialect("filter_eq", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING';", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
_dialect("filter_neq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus != 'F';", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
_dialect("filter_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '01/01/1997' AND o_orderdate < '1998-01-01' AND o_orderkey > 100;", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey > 100")
_dialect("filter_in", "2E5TAR p_partkey, p_size MEN part LAMA p_size FE (1, 5, 9);", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)")
_dialect("filter_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%0_7%';", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%0_7%'")
_dialect("filter_and_or_leftassoc", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_orderkey < 500;", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_orderkey < 500")
_dialect("filter_decimal_eps", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount = 0.05;", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05) < 0.0001")

# ---- sort, distinct, limit

_dialect("sort_multi", "SELECT c_nationkey, c_mktsegment, c_custkey FROM customer ORDER BY c_nationkey ASC, c_mktsegment NAZL, c_custkey;", "SELECT c_nationkey, c_mktsegment, c_custkey FROM customer ORDER BY 1, 2 DESC, 3")
_dialect("distinct_cols", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders;", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25;", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 25")
_dialect("topk_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey 7ADD 25 EBDA2MEN 50;", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 25 OFFSET 50")

# ---- joins

_OC = "SELECT o_orderkey, o_totalprice, c_name FROM orders {} JOIN customer ON orders.o_custkey = customer.c_custkey"
_dialect("join_inner", _OC.format("INNER") + ";", "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
for _kind, _name in (("LEFT", "left"), ("RIGHT", "right"), ("FULL OUTER", "full")):
    _dialect(f"join_{_name}", f"SELECT c_custkey, o_orderkey FROM customer {_kind} JOIN orders ON customer.c_custkey = orders.o_custkey;", f"SELECT c_custkey, o_orderkey FROM customer {_kind} JOIN orders ON c_custkey = o_custkey")
_dialect("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region;", "SELECT n_name, r_name FROM nation CROSS JOIN region")
_dialect("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON supplier.s_nationkey < nation.n_nationkey;", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey")
_dialect("join_theta_ge", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON supplier.s_nationkey >= nation.n_nationkey AND supplier.s_nationkey != nation.n_regionkey;", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey >= n_nationkey AND s_nationkey <> n_regionkey")
_dialect("join_multi_cond", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON customer.c_nationkey = supplier.s_nationkey AND customer.c_acctbal > supplier.s_acctbal;", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal")
_dialect("join_three_way", "SELECT l_orderkey, l_linenumber, o_orderdate, c_name FROM lineitem JOIN orders ON lineitem.l_orderkey = orders.o_orderkey ENTEDAH customer 3ALA orders.o_custkey = customer.c_custkey WHERE l_quantity > 45;", "SELECT l_orderkey, l_linenumber, o_orderdate, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45")


_dialect("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey;", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")


@_query("fk_violations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _fk_violations(spark: SparkSession, d: str) -> DataFrame:
    return ct.missing_parents(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, d, "orders").filter("o_orderstatus <> 'P'"), [("l_orderkey", "o_orderkey")])


@_query("fk_valid_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _fk_valid(spark: SparkSession, d: str) -> DataFrame:
    return ct.with_parents(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, d, "orders").filter("o_orderstatus = 'P'"), [("l_orderkey", "o_orderkey")])


# ---- aggregates: money is summed as a decimal, so that no order of rows changes the result


def _money(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


_dialect("agg_count", "SELECT o_orderstatus, COUNT(*) AS n, COUNT(o_custkey) AS n_cust FROM orders GROUP BY o_orderstatus;", "SELECT o_orderstatus, count(*) AS n, count(o_custkey) AS n_cust FROM orders GROUP BY 1")
_dialect("agg_sum", "SELECT p_brand, SUM(p_size) AS total FROM part MAGMO3A B p_brand;", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1")
_dialect("agg_avg", "SELECT p_brand, AVG(p_size) AS mean FROM part GROUP BY p_brand;", "SELECT p_brand, avg(p_size) AS mean FROM part GROUP BY 1")
_dialect("agg_min_max", "SELECT c_nationkey, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high FROM customer GROUP BY c_nationkey;", "SELECT c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1")
_dialect("agg_global", "SELECT COUNT(*) AS n, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, MAX(o_orderkey) AS last FROM orders;", "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, max(o_orderkey) AS last FROM orders")
_dialect("agg_group_by", "SELECT l_returnflag, COUNT(*) AS n, MAX(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag;", "SELECT l_returnflag, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1")


@_query("agg_group_by_multi", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _group_multi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_money("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n"))


_dialect("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12;", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
_dialect("agg_over_join", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey JOIN orders ON orders.o_custkey = customer.c_custkey GROUP BY n_name;", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
FLAGSHIP = "SELECT c_mktsegment, COUNT(*) AS n, MAX(o_totalprice) AS highest, MIN(o_orderkey) AS first FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 1000 GROUP BY c_mktsegment HAVING COUNT(*) > 5 ORDER BY n DESC, c_mktsegment LIMIT 4;"
_dialect("agg_complex", FLAGSHIP, "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS highest, min(o_orderkey) AS first FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 5 ORDER BY n DESC, 1 LIMIT 4")

# ---- bags


@_query("multiset_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey"))


@_query("multiset_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _except(spark: SparkSession, d: str) -> DataFrame:
    return tt.multiset_except(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey"))


# ---- data modification and constraints

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@_query("dml_insert_effect", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', 2), (101, NULL, 3)")
def _insert(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    none = F.lit(None).cast(n.schema)
    log = n.select(F.lit(None).cast(n.schema).alias("old"), F.struct(*n.columns).alias("new"))
    more = spark.createDataFrame([(100, "ATLANTIS", 2), (101, None, 3)], n.schema)
    return tt.snapshot(log.union(more.select(none.alias("old"), F.struct(*n.columns).alias("new"))))


@_query("dml_update_effect", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 1000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _update(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    hit = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 1000)
    return o.select("o_orderkey", F.when(hit, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@_query("dml_delete_effect", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey > 1000)")
def _delete(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(~((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") > 1000))).select("o_orderkey")


@_query("check_violations", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0)")
def _check(spark: SparkSession, d: str) -> DataFrame:
    return ct.check_violations(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") >= 0)


@_query("fk_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def _cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = ct.cascade(table(spark, d, "orders"), table(spark, d, "customer").filter("c_nationkey = 3"), [("o_custkey", "c_custkey")])
    return ct.cascade(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, [("l_orderkey", "o_orderkey")])


@_query("pk_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _pk(spark: SparkSession, d: str) -> DataFrame:
    return ct.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- time travel over the log of orders

T1, T2 = "1998-01-01 00:00:00", "1999-06-01 00:00:00"
_LOG = """
WITH log AS (
  SELECT o_orderkey * 4 AS lsn, o_orderdate AS ts, o_orderkey % 100 AS txn, 'I' AS op, o.*, o_orderstatus AS was FROM orders o
  UNION ALL SELECT o_orderkey * 4 + 1, o_orderdate + INTERVAL 30 DAY, o_orderkey % 100, 'U', o.* REPLACE ('U' AS o_orderstatus), o_orderstatus FROM orders o WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey * 4 + 2, o_orderdate + INTERVAL 60 DAY, o_orderkey % 100, 'D', o.*, CASE WHEN o_orderkey % 7 = 0 THEN 'U' ELSE o_orderstatus END FROM orders o WHERE o_orderkey % 11 = 0)
"""
_SNAP = _LOG + f", last AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ts DESC, lsn DESC) AS k FROM log WHERE {{}}) SELECT {_O} FROM last WHERE k = 1 AND op <> 'D'"
_AT1 = f"ts <= TIMESTAMP '{T1}'"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return tt.orders_log(table(spark, d, "orders"))


def _until(log: DataFrame, t: str) -> DataFrame:
    return log.filter(F.col("ts") <= F.lit(t).cast("timestamp_ntz"))


def _first_half(log: DataFrame) -> DataFrame:
    """Records up to the middle of the log's range of numbers, which one row tells all tasks."""
    middle = log.agg(F.floor((F.min("lsn") + F.max("lsn")) / 2).alias("_middle"))
    return log.crossJoin(F.broadcast(middle)).filter("lsn <= _middle").drop("_middle")


QUERIES["asof_forward"] = QUERIES["asof_snapshot"] = lambda s, d: tt.snapshot(_until(_log(s, d), T1))
QUERIES["asof_reverse"] = lambda s, d: tt.reverse(tt.snapshot(_log(s, d)), _log(s, d).filter(F.col("ts") > F.lit(T1).cast("timestamp_ntz")))
QUERIES["asof_latest_by_key"] = lambda s, d: tt.latest_by_key(_until(_log(s, d), T1), "o_orderkey")
QUERIES["asof_lsn"] = lambda s, d: tt.snapshot(_first_half(_log(s, d)))
QUERIES["asof_strategy"] = lambda s, d: tt.strategy(_log(s, d), 883612800000000)
QUERIES["committed_only_replay"] = lambda s, d: tt.snapshot(tt.committed(_until(_log(s, d), T1), s.range(100).filter("id % 10 <> 3").withColumnRenamed("id", "txn")))
for _name in ("asof_snapshot", "asof_forward", "asof_reverse", "asof_latest_by_key"):
    ORACLES[_name] = _SNAP.format(_AT1)
ORACLES["asof_lsn"] = _SNAP.format("lsn <= (SELECT (min(lsn) + max(lsn)) // 2 FROM log)")
ORACLES["committed_only_replay"] = _SNAP.format(_AT1 + " AND (txn % 10) <> 3")
ORACLES["asof_strategy"] = _LOG + f"SELECT count(*) FILTER ({_AT1}) AS n_before, count(*) FILTER (NOT {_AT1}) AS n_after, CASE WHEN count(*) FILTER ({_AT1}) < count(*) FILTER (NOT {_AT1}) THEN 'forward' ELSE 'reverse' END AS strategy FROM log"


@_query(
    "asof_diff",
    _LOG + f", d AS (SELECT * FROM log WHERE ts > TIMESTAMP '{T1}' AND ts <= TIMESTAMP '{T2}'), s AS (SELECT {_O}, 1 AS w FROM d WHERE op <> 'D' UNION ALL SELECT {_O.replace('o_orderstatus', 'was')}, -1 FROM d WHERE op <> 'I') SELECT {_O}, CAST(sum(w) AS BIGINT) AS weight FROM s GROUP BY ALL HAVING sum(w) <> 0",
)
def _diff(spark: SparkSession, d: str) -> DataFrame:
    return tt.diff(_until(_log(spark, d), T2).filter(F.col("ts") > F.lit(T1).cast("timestamp_ntz")))


@_query("recover_to_effect", _SNAP.format(_AT1))
def _recover(spark: SparkSession, d: str) -> DataFrame:
    """The live rows after the compensating records of RECOVER TO T1 have been appended."""
    log = _log(spark, d)
    undone = tt.diff(log.filter(F.col("ts") > F.lit(T1).cast("timestamp_ntz"))).withColumn("weight", -F.col("weight"))
    return tt.collapse(tt.signed(log).unionByName(undone))


# ---- analytics over events: the event type is the table, the user the user, ceil(value) the rows

def _rows() -> Column:
    return F.ceil("value").cast("long")


def _mutation() -> Column:
    return F.col("event_type").isin("signup", "purchase", "error")


_NOW = "WITH e AS (SELECT *, epoch_us(ts) AS us, CAST(ceil(value) AS BIGINT) AS rows, (SELECT max(epoch_us(ts)) + 1 FROM events) AS now_us FROM events)"
_WEEK = "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _week(spark: SparkSession, d: str) -> DataFrame:
    return an.between(_events(spark, d), F.lit("2024-01-08").cast("timestamp_ntz"), F.lit("2024-01-15").cast("timestamp_ntz"))


QUERIES["metrics_range_count"] = lambda s, d: _week(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
ORACLES["metrics_range_count"] = f"SELECT event_type, count(*) AS n FROM events WHERE {_WEEK} GROUP BY 1"
QUERIES["metrics_avg_duration"] = lambda s, d: _week(s, d).groupBy("event_type").agg(F.round(F.coalesce(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), F.lit(0.0)), 6).alias("avg_ms"))
ORACLES["metrics_avg_duration"] = f"SELECT event_type, round(coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 0.0), 6) AS avg_ms FROM events WHERE {_WEEK} GROUP BY 1"
QUERIES["metrics_mutation_count"] = lambda s, d: _week(s, d).filter(_mutation()).agg(F.sum(_rows()).alias("rows"))
ORACLES["metrics_mutation_count"] = f"SELECT CAST(sum(ceil(value)) AS BIGINT) AS rows FROM events WHERE {_WEEK} AND event_type IN ('signup', 'purchase', 'error')"
QUERIES["metrics_user_count"] = lambda s, d: _week(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
ORACLES["metrics_user_count"] = f"SELECT user_id, count(*) AS n FROM events WHERE {_WEEK} GROUP BY 1"
QUERIES["mutation_rate_current"] = lambda s, d: an.current_rates(_events(s, d), "event_type", _rows())
ORACLES["mutation_rate_current"] = _NOW + " SELECT event_type, CAST(sum(rows) AS DOUBLE) / 60.0 AS rate FROM e WHERE us >= now_us - 60000000 AND us < now_us GROUP BY 1"

_HOUR = 3_600_000_000
_DENSE = _NOW + f""", c AS (SELECT event_type, (now_us - 1 - us) // {_HOUR} AS bucket, CAST(sum(rows) AS DOUBLE) AS total FROM e GROUP BY ALL),
r AS (SELECT k.event_type, CAST(b AS INTEGER) AS bucket, coalesce(total, 0.0) / 3600.0 AS rate FROM (SELECT DISTINCT event_type FROM events) k CROSS JOIN range(100) t(b) LEFT JOIN c ON c.event_type = k.event_type AND c.bucket = b)"""
_ANOMALY = _DENSE + """, s AS (SELECT event_type, max(rate) FILTER (bucket = 0) AS rate, avg(rate) AS mean, stddev_pop(rate) AS sd, count(*) FILTER (rate > 0.001) AS active FROM r GROUP BY 1),
z AS (SELECT *, CASE WHEN active < 10 THEN CASE WHEN rate >= 50 THEN rate / 10 ELSE 0.0 END WHEN sd < 0.01 THEN CASE WHEN rate >= 5 AND (mean <= 0.001 OR rate >= 10 * mean) THEN 3.5 ELSE 0.0 END ELSE (rate - mean) / sd END AS z FROM s)"""


def _rates(s: SparkSession, d: str) -> DataFrame:
    return an.dense_rates(_events(s, d), "event_type", _rows(), _HOUR)


def _found(s: SparkSession, d: str) -> DataFrame:
    return an.anomalies(_rates(s, d), "event_type")


QUERIES["mutation_rates_dense"] = _rates
ORACLES["mutation_rates_dense"] = _DENSE + " SELECT event_type, bucket, rate FROM r"
QUERIES["anomaly_zscore"] = lambda s, d: _found(s, d).select("event_type", F.round("z", 6).alias("z"))
ORACLES["anomaly_zscore"] = _ANOMALY + " SELECT event_type, round(z, 6) AS z FROM z"


def _each_z(s: SparkSession, d: str) -> DataFrame:
    r = _rates(s, d)
    m = r.groupBy("event_type").agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("sd"))
    return r.join(m, "event_type").select("event_type", "bucket", scalar.severity(scalar.z_score(F.col("rate"), F.col("mean"), F.col("sd"))).alias("severity"))


QUERIES["anomaly_severity"] = lambda s, d: _each_z(s, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
ORACLES["anomaly_severity"] = _DENSE + """, m AS (SELECT event_type, avg(rate) AS mean, stddev_pop(rate) AS sd FROM r GROUP BY 1),
z AS (SELECT CASE WHEN sd < 0.01 THEN CASE WHEN rate >= 5 AND (mean <= 0.001 OR rate >= 10 * mean) THEN 3.5 ELSE 0.0 END ELSE (rate - mean) / sd END AS z FROM r JOIN m USING (event_type))
SELECT CASE WHEN abs(z) >= 4 THEN 'HIGH' WHEN abs(z) >= 3 THEN 'MEDIUM' WHEN abs(z) >= 2 THEN 'LOW' ELSE 'NONE' END AS severity, count(*) AS n FROM z GROUP BY 1"""
QUERIES["anomaly_report"] = lambda s, d: _found(s, d).select("event_type", "severity", F.round("z", 6).alias("z"), F.round("rate", 6).alias("rate"), F.round("mean", 6).alias("mean"), "active")
ORACLES["anomaly_report"] = _ANOMALY + " SELECT event_type, CASE WHEN active < 10 THEN CASE WHEN rate >= 50 THEN 'MEDIUM' ELSE 'NONE' END WHEN abs(z) >= 4 THEN 'HIGH' WHEN abs(z) >= 3 THEN 'MEDIUM' WHEN abs(z) >= 2 THEN 'LOW' ELSE 'NONE' END AS severity, round(z, 6) AS z, round(rate, 6) AS rate, round(mean, 6) AS mean, active FROM z"
QUERIES["mass_operation"] = lambda s, d: an.mass_operations(_events(s, d), _rows()).select("event_id", "rows", "severity")
ORACLES["mass_operation"] = _NOW + " SELECT event_id, rows, CASE WHEN rows >= 500 THEN 'HIGH' WHEN rows >= 200 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM e WHERE rows >= 50"

_ISLANDS = "WITH g AS (SELECT {0} AS k, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {0} ORDER BY ts) AS gap FROM events), i AS (SELECT k, us, sum(CASE WHEN gap IS NULL OR gap > {1} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM g), c AS (SELECT k, count(*) AS n, min(us) AS start_us, max(us) AS end_us, sum(us) AS total FROM i GROUP BY k, island HAVING count(*) >= 5)"
QUERIES["hotspots_dbscan"] = lambda s, d: an.hotspots(_events(s, d), 300)
ORACLES["hotspots_dbscan"] = _ISLANDS.format("0", 300_000_000) + " SELECT n, start_us, end_us, CAST(total // n AS BIGINT) AS center_us, CASE WHEN end_us > start_us THEN n / ((end_us - start_us) / 1e6) ELSE CAST(n AS DOUBLE) END AS density FROM c"
QUERIES["hotspots_session_window"] = lambda s, d: an.hotspots(_events(s, d), 1800, by="event_type").select("event_type", "n", "start_us", "end_us")
ORACLES["hotspots_session_window"] = _ISLANDS.format("event_type", 1_800_000_000) + " SELECT k AS event_type, n, start_us, end_us FROM c"
QUERIES["hotspots_by_gaps"] = lambda s, d: an.hotspots_by_gaps(_events(s, d), 7200, 5, "user_id")
ORACLES["hotspots_by_gaps"] = _ISLANDS.format("user_id", 7_200_000_000) + " SELECT k AS user_id, n, start_us, end_us FROM c"


def _daily(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).withColumn("bucket", F.floor(scalar.micros(F.col("ts")) / 21_600_000_000).cast("long"))
    return e.groupBy("event_type", "bucket").agg(F.sum(_rows()).alias("rows"))


QUERIES["cusum_change_points"] = lambda s, d: an.cusum(_daily(s, d), "event_type", "bucket", "rows", threshold=2.0)
ORACLES["cusum_change_points"] = """
WITH RECURSIVE s AS (SELECT event_type, epoch_us(ts) // 21600000000 AS bucket, CAST(sum(ceil(value)) AS DOUBLE) AS x FROM events GROUP BY ALL),
m AS (SELECT event_type, avg(x) AS mu, stddev_pop(x) AS sd, count(*) AS c FROM s GROUP BY 1),
o AS (SELECT s.*, mu, sd, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS k FROM s JOIN m USING (event_type) WHERE c >= 3 AND sd >= 0.001),
f AS (SELECT event_type, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS n, false AS hit, CAST(0 AS BIGINT) AS bucket, CAST(0 AS DOUBLE) AS x FROM m
  UNION ALL SELECT event_type, k, CASE WHEN a THEN 0.0 ELSE p END, CASE WHEN a THEN 0.0 ELSE n END, a, bucket, x FROM (
    SELECT o.event_type, o.k, o.bucket, o.x, greatest(0.0, f.p + o.x - mu - 0.5 * sd) AS p, greatest(0.0, f.n - o.x + mu - 0.5 * sd) AS n,
      greatest(0.0, f.p + o.x - mu - 0.5 * sd) > 2.0 * sd OR greatest(0.0, f.n - o.x + mu - 0.5 * sd) > 2.0 * sd AS a FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1))
SELECT event_type, bucket AS position, x AS value FROM f WHERE hit
"""
QUERIES["freq_histogram"] = lambda s, d: an.histogram(_events(s, d), 3600)
ORACLES["freq_histogram"] = "WITH m AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), c AS (SELECT (epoch_us(ts) - lo) // 3600000000 AS b, count(*) AS n FROM events, m GROUP BY 1) SELECT CAST(r.b AS BIGINT) AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(least((hi - lo) // 3600000000, 999) + 1)) AS b FROM m) r LEFT JOIN c ON c.b = r.b"
QUERIES["hot_timestamps"] = lambda s, d: an.hot_times(_events(s, d), 20)
ORACLES["hot_timestamps"] = "SELECT epoch_us(ts) // 1000000 * 1000000 AS second_us, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20"
QUERIES["access_last_n"] = lambda s, d: an.last_n(_events(s, d), "event_id", 1000).select("event_id", "ts")
ORACLES["access_last_n"] = "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000"


def _trigger(s: SparkSession, d: str) -> DataFrame:
    now = 1_705_276_800_000_000  # 2024-01-15
    spots = an.hotspots(_events(s, d).filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), 300)
    changes = an.cusum(_daily(s, d), "event_type", "bucket", "rows", threshold=2.0).withColumn("position", F.col("position") * 21_600_000_000)
    return an.snapshot_due(spots, changes, now, now - 60_000_000)


QUERIES["snapshot_trigger"] = _trigger
ORACLES["snapshot_trigger"] = (
    ORACLES["cusum_change_points"].strip().rsplit("SELECT event_type, bucket AS position", 1)[0]
    + f""", g AS (SELECT epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM events WHERE ts < TIMESTAMP '2024-01-15'),
i AS (SELECT us, sum(CASE WHEN gap IS NULL OR gap > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM g),
c AS (SELECT count(*) AS n, (max(us) - min(us)) / 1e6 AS sec FROM i GROUP BY island HAVING count(*) >= 5)
SELECT fresh_changes, dense_spots, fresh_changes > 0 OR dense_spots > 0 AS due FROM (SELECT count(*) FILTER (hit AND 1705276800000000 - bucket * 21600000000 < 300000000) AS fresh_changes FROM f), (SELECT count(*) FILTER (CASE WHEN sec > 0 THEN n / sec ELSE n END > 1 AND n >= 10) AS dense_spots FROM c)"""
)

_PROFILE = """WITH s AS (SELECT user_id, event_type IN ('signup', 'purchase', 'error') AS m, CAST(ceil(value) AS BIGINT) AS rows, epoch_us(ts) AS us FROM events),
p AS (SELECT user_id, count(*) FILTER (m) AS mutations, count(*) FILTER (NOT m) AS queries, CAST(coalesce(sum(rows) FILTER (m), 0) AS BIGINT) AS rows,
  greatest(coalesce(max(us) FILTER (m) - min(us) FILTER (m), 0), coalesce(max(us) FILTER (NOT m) - min(us) FILTER (NOT m), 0)) AS span_us FROM s GROUP BY 1)"""
QUERIES["user_profile"] = lambda s, d: an.profiles(_events(s, d), "user_id", _mutation(), _rows())
ORACLES["user_profile"] = _PROFILE + " SELECT *, CASE WHEN span_us > 0 THEN mutations / (span_us / 6e7) ELSE 0.0 END AS mutations_per_minute, CASE WHEN span_us > 0 THEN queries / (span_us / 6e7) ELSE 0.0 END AS queries_per_minute FROM p"


def _deviation(s: SparkSession, d: str) -> DataFrame:
    p = an.profiles(_events(s, d), "user_id", _mutation(), _rows())
    e = an.with_now(_events(s, d)).filter(_mutation() & (scalar.micros(F.col("ts")) >= F.col("now_us") - 86_400_000_000))
    recent = e.groupBy("user_id").agg((F.count(F.lit(1)) / 1440.0).alias("recent"))
    return p.join(recent, "user_id", "left").select("user_id", F.round(an.deviation(F.col("mutations") + F.col("queries"), F.coalesce("recent", F.lit(0.0)), F.col("mutations_per_minute")), 9).alias("deviation"))


QUERIES["user_deviation"] = _deviation
ORACLES["user_deviation"] = _PROFILE + ", r AS (SELECT user_id, count(*) / 1440.0 AS recent FROM s WHERE m AND us >= (SELECT max(us) + 1 FROM s) - 86400000000 GROUP BY 1), a AS (SELECT *, CASE WHEN span_us > 0 THEN mutations / (span_us / 6e7) ELSE 0.0 END AS mpm FROM p) SELECT user_id, round(CASE WHEN mutations + queries < 20 THEN 0.0 ELSE 0.7 * abs(coalesce(recent, 0.0) - mpm) / greatest(mpm, 1.0) END, 9) AS deviation FROM a LEFT JOIN r USING (user_id)"


def _sql_first(kinds: dict[str, tuple[str, ...]], what: str) -> str:
    whens = " ".join("WHEN contains(low, '{}') THEN '{}'".format(p.replace("'", "''"), (level if what == "severity" else p).replace("'", "''")) for level, ps in kinds.items() for p in ps)
    return f"CASE {whens} ELSE {"NULL" if what == "pattern" else "'NONE'"} END"


def _texts(s: SparkSession, d: str) -> DataFrame:
    """Pages, and documents after an access to a login form that every third of them imitates."""
    docs = table(s, d, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("' OR '1'='1"))).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("1; DROP TABLE "), F.col("text"))).otherwise(F.col("text"))
    return table(s, d, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("text")).union(docs.select("doc_id", F.lit("document"), text))


_TEXTS = "WITH t AS (SELECT page_id AS id, 'page' AS kind, lower(html) AS low FROM pages UNION ALL SELECT doc_id, 'document', lower(CASE WHEN doc_id % 3 = 0 THEN text || ''' OR ''1''=''1' WHEN doc_id % 5 = 0 THEN '1; DROP TABLE ' || text ELSE text END) FROM documents)"
_BOTH = _TEXTS + f", s AS (SELECT id, kind, {_sql_first(an.SQL_PATTERNS, 'severity')} AS sql_severity, {_sql_first(an.SQL_PATTERNS, 'pattern')} AS sql_pattern, {_sql_first(an.SCRIPT_PATTERNS, 'severity')} AS script_severity, {_sql_first(an.SCRIPT_PATTERNS, 'pattern')} AS script_pattern FROM t)"
_RANK = "CASE {} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
QUERIES["threat_sqli"] = lambda s, d: an.threats(_texts(s, d), "text").select("id", "kind", "sql_severity", "sql_pattern")
ORACLES["threat_sqli"] = _BOTH + " SELECT id, kind, sql_severity, sql_pattern FROM s"
QUERIES["threat_xss"] = lambda s, d: an.threats(_texts(s, d), "text").select("id", "kind", "script_severity", "script_pattern")
ORACLES["threat_xss"] = _BOTH + " SELECT id, kind, script_severity, script_pattern FROM s"
QUERIES["threat_combined"] = lambda s, d: an.threats(_texts(s, d), "text").select("id", "kind", "threat", "severity")
ORACLES["threat_combined"] = _BOTH + f", r AS (SELECT *, {_RANK.format('sql_severity')} >= {_RANK.format('script_severity')} AS sql_ FROM s) SELECT id, kind, CASE WHEN sql_severity = 'NONE' AND script_severity = 'NONE' THEN 'NONE' WHEN sql_ THEN 'SQL_INJECTION' ELSE 'XSS' END AS threat, CASE WHEN sql_ THEN sql_severity ELSE script_severity END AS severity FROM r"

# ---- learned choices: an event is an execution, its id's parity the arm, its value the milliseconds


def _feedback(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).select((F.col("event_id") % 2).cast("int").alias("arm"), F.col("event_type").alias("table_name"), F.col("value").alias("ms"), "event_id")


_FEED = "WITH f AS (SELECT CAST(event_id % 2 AS INTEGER) AS arm, event_type AS table_name, CAST(floor(1.0 / (1.0 + value / 100.0) * 10000) AS BIGINT) AS rw FROM events)"
_ARMS = _FEED + ", a AS (SELECT {0}, count(*) AS pulls, sum(rw) / 10000.0 / count(*) AS avg_reward FROM f GROUP BY ALL), u AS (SELECT *, avg_reward + 1.414 * sqrt(ln(CAST((SELECT sum(pulls) FROM a) AS DOUBLE)) / pulls) AS ucb FROM a)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"avg_reward": F.round("avg_reward", 9), "ucb": F.round("ucb", 9)})


QUERIES["ucb1_arm_stats"] = lambda s, d: _rounded(an.arm_stats(_feedback(s, d), ["arm", "table_name"]))
ORACLES["ucb1_arm_stats"] = _ARMS.format("arm, table_name") + " SELECT arm, table_name, pulls, round(avg_reward, 9) AS avg_reward, round(ucb, 9) AS ucb FROM u"
QUERIES["ucb1_choice"] = lambda s, d: an.choose_arm(an.arm_stats(_feedback(s, d), ["arm"]))
ORACLES["ucb1_choice"] = _ARMS.format("arm") + " SELECT (SELECT arm FROM u ORDER BY ucb DESC, arm LIMIT 1) AS arm, CAST(sum(pulls) AS BIGINT) AS total FROM u"
QUERIES["optimizer_arm_stats"] = lambda s, d: _rounded(an.arm_stats(_feedback(s, d).withColumn("arm", (F.col("event_id") % 3).cast("int")), ["arm"]))
ORACLES["optimizer_arm_stats"] = _ARMS.format("arm").replace("event_id % 2", "event_id % 3") + " SELECT arm, pulls, round(avg_reward, 9) AS avg_reward, round(ucb, 9) AS ucb FROM u"
QUERIES["selectivity_model"] = lambda s, d: _events(s, d).groupBy("event_type", (F.col("event_id") % 4).cast("int").alias("n_conditions")).agg(F.round(F.sum(F.floor(F.col("value") * 100).cast("long")) / 50000.0 / F.count(F.lit(1)), 9).alias("selectivity"))
ORACLES["selectivity_model"] = "SELECT event_type, CAST(event_id % 4 AS INTEGER) AS n_conditions, round(sum(CAST(floor(value * 100) AS BIGINT)) / 50000.0 / count(*), 9) AS selectivity FROM events GROUP BY 1, 2"
QUERIES["decay_factor"] = lambda s, d: _events(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).select("day", "n", F.round(scalar.decay_factor(F.col("n")), 9).alias("factor"))
ORACLES["decay_factor"] = "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(CASE WHEN count(*) < 5 THEN 1.0 WHEN count(*) / 100.0 <= 1 THEN 1.0 - 0.2 * count(*) / 100.0 ELSE 0.8 - 0.2 * least((count(*) / 100.0 - 1.0) / 2.0, 1.0) END, 9) AS factor FROM events GROUP BY 1"


def _scan_choices(s: SparkSession, d: str) -> DataFrame:
    kinds = _events(s, d).select(F.col("event_type").alias("table_name")).distinct()
    kept = F.when(F.col("table_name") == "view", 0.9).when(F.col("table_name") == "click", 0.01).otherwise(0.2)
    return learning.choose_by_table(_feedback(s, d), kinds.withColumn("has_index", F.col("table_name") != "error").withColumn("selectivity", kept))


QUERIES["scan_choice_by_table"] = _scan_choices
ORACLES["scan_choice_by_table"] = _FEED + """, e AS (SELECT table_name, count(*) FILTER (arm = 0) AS p0, count(*) FILTER (arm = 1) AS p1, sum(rw) FILTER (arm = 0) AS r0, sum(rw) FILTER (arm = 1) AS r1 FROM f GROUP BY 1),
g AS (SELECT sum(p0) AS a0, sum(p1) AS a1, sum(p0) + sum(p1) AS n, sum(r0) / 10000.0 / sum(p0) AS q0, sum(r1) / 10000.0 / sum(p1) AS q1 FROM e),
u AS (SELECT table_name, q0, q1, p0 >= 10 AND p1 >= 10 AS own, CASE table_name WHEN 'view' THEN 0.9 WHEN 'click' THEN 0.01 ELSE 0.2 END AS kept,
  CASE WHEN p0 >= 10 AND p1 >= 10 THEN r0 / 10000.0 / p0 + 1.414 * sqrt(ln(CAST(n AS DOUBLE)) / p0) ELSE q0 + 1.414 * sqrt(ln(CAST(n AS DOUBLE)) / a0) END AS s0,
  CASE WHEN p0 >= 10 AND p1 >= 10 THEN r1 / 10000.0 / p1 + 1.414 * sqrt(ln(CAST(n AS DOUBLE)) / p1) ELSE q1 + 1.414 * sqrt(ln(CAST(n AS DOUBLE)) / a1) END AS s1 FROM e, g)
SELECT table_name, own, CAST(CASE WHEN table_name = 'error' THEN 0 WHEN kept < 0.05 AND s1 <= s0 AND q1 > q0 * 0.8 THEN 1 WHEN kept > 0.5 AND s1 > s0 AND q0 > q1 * 0.8 THEN 0 WHEN s1 > s0 THEN 1 ELSE 0 END AS INTEGER) AS arm FROM u"""


def _plans(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return _events(s, d).select((k % 3).cast("int").alias("filter_arm"), (k % 5 > 1).cast("int").alias("limit_arm"), (k % 4).alias("n_conditions"), (k % 2 == 0).alias("had_limit"), (k % 7 == 0).alias("had_order"), F.col("value").alias("ms"))


QUERIES["plan_arms"] = lambda s, d: _rounded(learning.plan_arms(_plans(s, d)))
ORACLES["plan_arms"] = """WITH f AS (SELECT event_id AS k, CAST(floor(1.0 / (1.0 + value / 100.0) * 10000) AS BIGINT) AS rw FROM events),
b AS (SELECT 'filter' AS kind, CAST(k % 3 AS INTEGER) AS arm, rw FROM f WHERE k % 4 > 1 UNION ALL SELECT 'limit', CASE WHEN k % 5 > 1 THEN 1 ELSE 0 END, rw FROM f WHERE k % 2 = 0 AND k % 7 <> 0),
a AS (SELECT kind, arm, count(*) AS pulls, sum(rw) / 10000.0 / count(*) AS avg_reward FROM b GROUP BY 1, 2)
SELECT kind, arm, pulls, round(avg_reward, 9) AS avg_reward, round(avg_reward + 1.414 * sqrt(ln(CAST(sum(pulls) OVER (PARTITION BY kind) AS DOUBLE)) / pulls), 9) AS ucb FROM a"""
