import math
import random
import threading
import time

import pytest

from tempora.dialect.parser import parse
from tempora.operators import learning
from tempora.operators.learning import Bandit
from tempora.response import Guard
from tempora.session import Session, SessionError
from tempora.sources.changelog import PrunedError
from tempora.streaming.scheduler import Scheduler


def test_scan_choices_by_table_are_those_of_one_execution_at_a_time(spark):
    r = random.Random(3)
    tables = {"small": (4, 90), "large": (800, 30), "thin": (50, 60)}
    feedback = [(a, t, tables[t][a] + r.random()) for t in tables for a in (0, 1) for _ in range(4 if t == "thin" else 40)]
    kept = {"small": 0.2, "large": 0.2, "thin": 0.01, "unseen": 0.9}
    features = [(t, i, k) for t, k in kept.items() for i in (True, False)] + [("thin", True, 0.9), ("large", True, 0.9)]
    fs = "table_name string, has_index boolean, selectivity double"
    for some in (feedback, feedback[:20], feedback[:44], []):
        b = Bandit()
        for x in some:
            b.record(*x)
        got = learning.choose_by_table(spark.createDataFrame(some, "arm int, table_name string, ms double"), spark.createDataFrame(features, fs)).collect()
        assert sorted((x.table_name, x.arm) for x in got) == sorted((t, b.choose(t, i, k)) for t, i, k in features)
    b = Bandit()
    for x in feedback:
        b.record(*x)
    assert (b.choose("small", True, 0.2), b.choose("large", True, 0.2)) == (0, 1)
    same = Bandit.loads(b.dumps())
    assert same.stats() == b.stats() and same.tables == b.tables
    b.decay(0.5)
    assert b.pulls == [42, 42] and b.tables["thin"] == [[2, b.tables["thin"][0][1]], [2, b.tables["thin"][1][1]]]
    b.decay(0.0)
    assert b.pulls == [0, 0] and not b.tables


def test_plan_arms_count_queries_that_had_the_choice(spark):
    rows = [(i % 3, i % 2, 2, i < 80, False, 10.0) for i in range(150)] + [(0, 0, 1, False, True, 10.0)] * 9
    got = {(x.kind, x.arm): x.pulls for x in learning.plan_arms(spark.createDataFrame(rows, "filter_arm int, limit_arm int, n_conditions int, had_limit boolean, had_order boolean, ms double")).collect()}
    assert got == {("filter", 0): 50, ("filter", 1): 50, ("filter", 2): 50, ("limit", 0): 40, ("limit", 1): 40}


def test_features_of_a_query():
    s = parse("SELECT a, b FROM t WHERE a LIKE 'x%' AND b IN (1, 2) AND c = 1 AND d > 2 ORDER BY a LIMIT 3;")
    f = learning.features(s, 1024, 9, frozenset({"a"}))
    assert f == {"log2_rows": 10.0, "conditions": 4.0, "first_is_equality": 0.0, "has_index": 1.0, "selectivity": pytest.approx(0.25 * 0.1 * 0.33), "columns": 2.0, "ordered": 1.0, "limited": 1.0}
    assert [learning.filter_order(s.where, arm) for arm in (0, 1, 2)] == [[0, 1, 2, 3], [0, 1, 2, 3], [2, 3, 1, 0]]
    assert learning.filter_order(s.where, 1, {("d", ">"): 0.1, ("a", "LIKE"): 0.9}) == [3, 1, 2, 0]
    empty = learning.features(parse("SELECT * FROM t;"), 0, 9)
    assert (empty["log2_rows"], empty["selectivity"], empty["columns"], empty["has_index"]) == (0.0, 1.0, 9.0, 0.0) and math.isfinite(empty["selectivity"])


def test_fetched_queries_are_counted_and_kept(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/db")
    s.execute("CREATE TABLE t (a INT);")
    s.execute("CREATE INDEX i ON t (a);")
    s.execute("INSERT INTO t VALUES (1), (2);")
    assert [x.a for x in s.fetch("SELECT a FROM t WHERE a = 2;")] == [2]
    assert len(s.fetch("SELECT a FROM t;")) == 2
    assert [(x[0], x[1]) for x in s.execute("SHOW EXECUTION STATS;").data.collect()] == [("Sequential Scan", "1"), ("Index Scan", "1")]
    s.execute("CHECKPOINT;")
    assert Session(spark, s.root).learned.pulls == [1, 1]
    with pytest.raises(SessionError):
        s.fetch("DELETE FROM t;")


def test_a_pruned_log_reaches_back_to_its_cutoff(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/db")
    s.execute("CREATE TABLE t (a INT);")
    times = []
    for i in (1, 2, 3):
        s.execute(f"INSERT INTO t VALUES ({i});")
        times.append(time.time_ns() // 1000)
    log, week = s.log_of("t"), 7 * 86_400_000_000
    assert s.retain(now_us=times[1] + week) == times[1]
    assert len(log.manifest()["segments"]) == 1 and len(log.files.list(f"{log.path}/segments")) == 1
    past = lambda t: sorted(x.a for x in s.table("t", t).collect())
    assert (past(times[1]), past(times[2])) == ([1, 2], [1, 2, 3])
    with pytest.raises(PrunedError):
        past(times[0])
    with pytest.raises(PrunedError):
        log.back(times[0])
    s.execute("DELETE FROM t WHERE a = 1;")
    assert sorted(x.a for x in s.table("t").collect()) == [2, 3] and past(times[2]) == [1, 2, 3]
    day = 86_400_000_000
    assert s.retain([times[2] - 8 * day], now_us=times[2]) == times[2] - 9 * day


def test_unusual_writing_is_blocked_or_taken_back(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/db")
    now = [time.time_ns() // 1000]
    g = Guard(s, lambda: now[0])
    s.execute("CREATE TABLE t (a VARCHAR(40));")
    s.execute("INSERT INTO t VALUES ('x');")
    assert g.analyse() == []  # warm-up
    with pytest.raises(SessionError):
        s.execute("SELECT a FROM t WHERE a = '<script>';")
    assert (g.tables, g.users) == ({"t"}, {"root"}) and len(s.execute("SELECT a FROM t;").data.collect()) == 1
    with pytest.raises(SessionError):
        s.execute("INSERT INTO t VALUES ('y');")
    g.unblock("t", "root")
    s.execute("INSERT INTO t VALUES ('y');")
    g.respond("LOW", "t")
    assert not g.tables
    g.respond("HIGH", "t", at=time.time_ns() // 1000 + 59_000_000)  # back by a minute, to before the last row or so
    assert not g.tables and g.cooling("t")
    g.respond("MEDIUM", "t")
    assert not g.tables  # cooling down
    now[0] += 61_000_000
    g.respond("MEDIUM", "t", "root")
    assert (g.tables, g.users) == ({"t"}, {"root"}) and g.analyse() == []  # the log has rested


def test_a_burst_on_a_thin_baseline_blocks(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/db")
    now = [time.time_ns() // 1000]
    g = Guard(s, lambda: now[0])
    s.execute("CREATE TABLE t (a INT);")
    s.execute("CREATE TABLE quiet (a INT);")
    s.execute("INSERT INTO quiet VALUES (1);")
    s.execute("INSERT INTO t VALUES " + ", ".join(f"({i})" for i in range(3100)) + ";")
    now[0] = max(now[0] + 31_000_000, time.time_ns() // 1000)
    assert g.analyse() == [("t", "MEDIUM")] and g.tables == {"t"}


def test_scheduled_jobs_run_at_their_times():
    seen, done = [], threading.Event()

    def fails():
        raise ValueError("on purpose")

    s = Scheduler(0.01)
    s.once(0.02, lambda: seen.append("once"))
    s.once(0.02, fails)
    gone = s.once(0.03, lambda: seen.append("never"))
    assert s.cancel(gone) and not s.cancel(gone)
    s.every(0.02, lambda: (seen.append("often"), seen.count("often") > 2 and done.set()))
    assert done.wait(20)
    s.stop()
    assert seen.count("once") == 1 and "never" not in seen
