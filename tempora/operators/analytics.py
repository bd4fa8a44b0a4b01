"""Analytics over event streams, in batch: rates, anomalies, change points, hotspots, profiles, threats and learned choices.

Events are (ts, table, user, rows). "Now" is a parameter or the newest event plus one microsecond, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalar import mass_severity, micros, reward, severity, ucb1, z_score

MINUTE, HISTORY, RETENTION = 60_000_000, 100, 600_000_000
LEAST_BASELINE, BURST = 10, 50.0
HOT_GAP, HOT_LEAST = 60, 5
#: Seconds within which the times of a hotspot are first put together.
STRETCH_S = 600

#: What marks a hostile text, by kind and severity, in order of precedence.
SQL_PATTERNS = {
    "HIGH": ("union select", "union all select", "; drop ", "; delete ", "; truncate ", "; update ", "; insert ", "into outfile", "into dumpfile", "load_file("),
    "MEDIUM": (
        "or 1=1", "or '1'='1", "' or '", "or true--", "or true;", "' or true", "sleep(", "benchmark(", "waitfor delay", "'; --", "' --", "'/*", "*/or/*", "char(0x", "exec(", "execute(", "xp_cmdshell", "information_schema",
    ),
    "LOW": ("' or 1", "'a'='a", "1' or '1", "admin'--"),
}
SCRIPT_PATTERNS = {
    "HIGH": ("<script", "javascript:", "eval(", "document.cookie", "document.write(", "document.location", "window.location", ".innerhtml"),
    "MEDIUM": ("onerror=", "onload=", "onclick=", "onmouseover=", "onfocus=", "onsubmit=", "<iframe", "<object", "<embed", "<svg onload", "<img src=", "<body onload"),
    "LOW": ("alert(", "prompt(", "confirm(", "<marquee"),
}


def newest(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: now_us, a microsecond after the newest event."""
    return df.agg((F.max(micros(F.col(ts))) + 1).alias("now_us"))


def with_now(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Every event with now_us; the single row is broadcast."""
    return df.crossJoin(F.broadcast(newest(df, ts)))


# ---- metrics


def between(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def average(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


# ---- rates and anomalies


def current_rates(events: DataFrame, key: str, rows: Column) -> DataFrame:
    """Rows a second over the last minute, by key."""
    e = with_now(events).filter((micros(F.col("ts")) >= F.col("now_us") - MINUTE) & (micros(F.col("ts")) < F.col("now_us")))
    return e.groupBy(key).agg((F.sum(rows).cast("double") / 60.0).alias("rate"))


def dense_rates(events: DataFrame, key: str, rows: Column, width: int = MINUTE, n: int = HISTORY) -> DataFrame:
    """(key, bucket, rate): n buckets by age, 0 the newest, none left out. The calendar is n rows a key, made after the aggregation."""
    us = micros(F.col("ts"))
    e = with_now(events)
    age = F.floor((F.col("now_us") - 1 - us) / width).cast("int")
    counts = e.withColumn("bucket", age).filter((F.col("bucket") >= 0) & (F.col("bucket") < n)).groupBy(key, "bucket").agg(F.sum(rows).cast("double").alias("total"))
    keys = events.select(key).distinct()
    calendar = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    return calendar.join(counts, [key, "bucket"], "left").select(key, "bucket", (F.coalesce("total", F.lit(0.0)) / (width / 1e6)).alias("rate"))


def anomalies(rates: DataFrame, key: str) -> DataFrame:
    """For each key the newest bucket's rate against the whole history: mean, deviation, z-score, severity and the gate for thin baselines."""
    current = F.max(F.when(F.col("bucket") == 0, F.col("rate")))
    s = rates.groupBy(key).agg(current.alias("rate"), F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("sd"), F.count_if(F.col("rate") > 0.001).alias("active"))
    s = s.withColumn("z", z_score(F.col("rate"), F.col("mean"), F.col("sd")))
    thin = F.col("active") < LEAST_BASELINE
    return s.withColumn("z", F.when(thin, F.when(F.col("rate") >= BURST, F.col("rate") / 10.0).otherwise(0.0)).otherwise(F.col("z"))).withColumn(
        "severity", F.when(thin, F.when(F.col("rate") >= BURST, "MEDIUM").otherwise("NONE")).otherwise(severity(F.col("z")))
    )


def mass_operations(events: DataFrame, rows: Column) -> DataFrame:
    return events.withColumn("rows", rows).withColumn("severity", mass_severity(F.col("rows"))).filter("severity <> 'NONE'")


# ---- hotspots and change points


def hotspots(events: DataFrame, gap_s: int = HOT_GAP, least: int = HOT_LEAST, by: str | None = None) -> DataFrame:
    """Clusters of times whose gaps are gap_s at most, with `least` members.

    Times are clustered within stretches of ``STRETCH_S`` seconds (or gap_s, if that is longer). Only clusters within reach of a stretch's ends, two a
    stretch at most, can go on in the next one; these alone are put in order and joined.
    """
    keys, width, gap = [by] if by else [], max(STRETCH_S, gap_s) * 1_000_000, gap_s * 1_000_000
    e = events.select(*keys, F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).filter("us IS NOT NULL").withColumn("stretch", F.floor(F.col("us") / width))
    w = Window.partitionBy(*keys, "stretch").orderBy("us")
    e = e.withColumn("new", (F.col("us") - F.lag("us").over(w) > gap).cast("int"))
    e = e.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = (F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    part = e.groupBy(*keys, "stretch", "island").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"), F.sum(F.col("us").cast("decimal(38,0)")).alias("total"))
    part = part.withColumn("open", (F.col("start_us") - F.col("stretch") * width <= gap) | ((F.col("stretch") + 1) * width - F.col("end_us") <= gap))
    order = Window.partitionBy(*keys).orderBy("start_us")
    edge = part.filter("open").withColumn("new", (F.col("start_us") - F.lag("end_us").over(order) > gap).cast("int"))
    edge = edge.withColumn("cluster", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "cluster").agg(*sums)
    columns = [*keys, "start_us", "end_us", "n", "total"]
    out = part.filter("NOT open").select(*columns).unionByName(edge.select(*columns)).filter(F.col("n") >= least)
    out = out.withColumn("center_us", F.floor(F.col("total") / F.col("n")).cast("long"))
    seconds = (F.col("end_us") - F.col("start_us")) / 1e6
    return out.select(*keys, "n", "start_us", "end_us", "center_us", F.when(seconds > 0, F.col("n") / seconds).otherwise(F.col("n").cast("double")).alias("density"))


def hotspots_by_gaps(events: DataFrame, gap_s: int, least: int, by: str) -> DataFrame:
    """The same by gaps and islands within each key."""
    w = Window.partitionBy(by).orderBy("us")
    e = events.select(by, micros(F.col("ts")).alias("us"))
    e = e.withColumn("new", F.coalesce((F.col("us") - F.lag("us").over(w) > gap_s * 1_000_000).cast("int"), F.lit(1)))
    e = e.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = e.groupBy(by, "island").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return out.filter(F.col("n") >= least).drop("island")


def cusum(series: DataFrame, key: str, order: str, value: str, drift: float = 0.5, threshold: float = 4.0) -> DataFrame:
    """(key, position) of change points: two-sided sums against the whole series' mean, reset on alarm. A series is one bounded array (the
    dense calendar of a key), folded in order."""
    s = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x")))).alias("xs"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    s = s.filter((F.size("xs") >= 3) & (F.col("sd") >= 0.001))
    start = F.expr("named_struct('p', 0D, 'n', 0D, 'hits', cast(array() as array<struct<o: bigint, x: double>>))")

    def step(a: Column, e: Column) -> Column:
        p = F.greatest(F.lit(0.0), a["p"] + e["x"] - F.col("mu") - drift * F.col("sd"))
        n = F.greatest(F.lit(0.0), a["n"] - e["x"] + F.col("mu") - drift * F.col("sd"))
        alarm = (p > threshold * F.col("sd")) | (n > threshold * F.col("sd"))
        hit = F.struct(e["o"].cast("long").alias("o"), e["x"].alias("x"))
        return F.struct(F.when(alarm, 0.0).otherwise(p).alias("p"), F.when(alarm, 0.0).otherwise(n).alias("n"), F.when(alarm, F.concat(a["hits"], F.array(hit))).otherwise(a["hits"]).alias("hits"))

    return s.select(key, F.explode(F.aggregate("xs", start, step)["hits"]).alias("h")).select(key, F.col("h.o").alias("position"), F.col("h.x").alias("value"))


def histogram(events: DataFrame, width_s: int, most: int = 1000) -> DataFrame:
    """(bucket, n) from the first event on, empty buckets included, `most` buckets at most."""
    us, w = micros(F.col("ts")), width_s * 1_000_000
    first = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    counts = events.crossJoin(F.broadcast(first)).groupBy(F.floor((us - F.col("lo")) / w).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    top = F.least(F.floor((F.col("hi") - F.col("lo")) / w), F.lit(most - 1)).cast("long")
    calendar = first.filter("lo IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("bucket"))
    return calendar.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def hot_times(events: DataFrame, k: int = 10) -> DataFrame:
    sec = (F.floor(micros(F.col("ts")) / 1_000_000) * 1_000_000).cast("long").alias("second_us")
    return events.groupBy(sec).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "second_us").limit(k)


def last_n(events: DataFrame, key: str, n: int = 1000) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc(key)).limit(n)


def snapshot_due(spots: DataFrame, changes: DataFrame, now_us: int, last_us: int, time: str = "position") -> DataFrame:
    """One row: whether a smart snapshot is due, which takes 30 s since the last one, and a change point of the last 5 minutes or a dense hotspot of 10."""
    fresh = changes.agg(F.count_if((F.lit(now_us) - F.col(time)) < 300_000_000).alias("fresh_changes"))
    dense = spots.agg(F.count_if((F.col("density") > 1.0) & (F.col("n") >= 10)).alias("dense_spots"))
    return fresh.crossJoin(dense).withColumn("due", F.lit(now_us - last_us >= 30_000_000) & ((F.col("fresh_changes") > 0) | (F.col("dense_spots") > 0)))


# ---- users


def profiles(events: DataFrame, user: str, is_mutation: Column, rows: Column) -> DataFrame:
    """Mutations and queries a minute over the longer of the two spans, and totals."""
    us = micros(F.col("ts"))
    span = lambda c: F.coalesce(F.max(F.when(c, us)) - F.min(F.when(c, us)), F.lit(0))
    s = events.groupBy(user).agg(F.count_if(is_mutation).alias("mutations"), F.count_if(~is_mutation).alias("queries"), F.coalesce(F.sum(F.when(is_mutation, rows)), F.lit(0)).cast("long").alias("rows"), F.greatest(span(is_mutation), span(~is_mutation)).alias("span_us"))
    minutes = F.col("span_us") / 6e7
    per = lambda c: F.when(minutes > 0, F.col(c) / minutes).otherwise(0.0)
    return s.withColumn("mutations_per_minute", per("mutations")).withColumn("queries_per_minute", per("queries"))


def deviation(total: Column, recent: Column, avg: Column) -> Column:
    return F.when(total < 20, 0.0).otherwise(0.7 * F.abs(recent - avg) / F.greatest(avg, F.lit(1.0)))


# ---- threats


def _first(text: Column, kinds: dict[str, tuple[str, ...]]) -> tuple[Column, Column]:
    """(severity, pattern): the first pattern of the gravest severity; one pass over the text for each pattern until one hits."""
    sev = pat = None
    for level, patterns in kinds.items():
        for p in patterns:
            hit = F.contains(text, F.lit(p))
            sev = F.when(hit, level) if sev is None else sev.when(hit, level)
            pat = F.when(hit, p) if pat is None else pat.when(hit, p)
    return sev.otherwise("NONE"), pat


def threats(df: DataFrame, text: str) -> DataFrame:
    """df with sql_severity, sql_pattern, script_severity, script_pattern and the graver kind; SQL wins ties."""
    low = df.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    s, sp = _first(F.col("_low"), SQL_PATTERNS)
    x, xp = _first(F.col("_low"), SCRIPT_PATTERNS)
    out = low.withColumns({"sql_severity": s, "sql_pattern": sp, "script_severity": x, "script_pattern": xp}).drop("_low")
    rank = lambda c: F.when(F.col(c) == "HIGH", 3).when(F.col(c) == "MEDIUM", 2).when(F.col(c) == "LOW", 1).otherwise(0)
    sql = rank("sql_severity") >= rank("script_severity")
    none = (F.col("sql_severity") == "NONE") & (F.col("script_severity") == "NONE")
    return out.withColumns({"threat": F.when(none, "NONE").when(sql, "SQL_INJECTION").otherwise("XSS"), "severity": F.when(sql, F.col("sql_severity")).otherwise(F.col("script_severity"))})


# ---- learned choices


def arm_stats(feedback: DataFrame, by: list[str]) -> DataFrame:
    """Pulls, mean reward (kept as ten-thousandths, cut) and UCB1 score of each arm; feedback (arm, ms, by)."""
    s = feedback.groupBy(*by).agg(F.count(F.lit(1)).alias("pulls"), F.sum(F.floor(reward(F.col("ms")) * 10000).cast("long")).alias("reward_x10000"))
    total = s.agg(F.sum("pulls").alias("total"))
    s = s.crossJoin(F.broadcast(total)).withColumn("avg_reward", F.col("reward_x10000") / 10000.0 / F.col("pulls"))
    return s.withColumn("ucb", ucb1(F.col("avg_reward"), F.col("pulls"), F.col("total"))).drop("total", "reward_x10000")


def choose_arm(stats: DataFrame, least_pulls: int = 5, least_total: int = 30) -> DataFrame:
    """The arm to use next: alternating while there is little, an arm short of pulls next, then the best score."""
    s = stats.agg(F.sum("pulls").alias("total"), F.min_by("arm", F.struct("pulls", "arm")).alias("rarest"), F.min("pulls").alias("least"), F.max_by("arm", F.struct("ucb", -F.col("arm"))).alias("best"))
    arm = F.when(F.col("total") < least_total, F.when(F.col("total") % 2 == 0, 1).otherwise(0)).when(F.col("least") < least_pulls, F.col("rarest")).otherwise(F.col("best"))
    return s.select(arm.cast("int").alias("arm"), "total")


def retention_cutoff_s(hot_ages_s: list[float], cold_s: float = 604_800.0, hot_s: float = 86_400.0) -> float:
    """How long the log is kept: a week, and a day beyond any much-used time that is older than a day and within twice the cutoff."""
    for age in hot_ages_s:
        if hot_s < age < 2 * cold_s:
            cold_s = max(cold_s, age + hot_s)
    return cold_s
