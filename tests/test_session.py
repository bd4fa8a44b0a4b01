import time

import pytest

from tempora import formats
from tempora.functions.scalar import as_of_micros, coerce, decay_factor
from tempora.session import Session, SessionError, threat_veto
from tempora.sources.changelog import ConflictError, Journal


@pytest.fixture()
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/db")


def got(r):
    return sorted(tuple(x) for x in r.data.collect())


def test_time_travel_and_recovery(s):
    s.execute("CREATE TABLE bank (id INT PRIMARY KEY, money INT);")
    s.execute("INSERT INTO bank VALUES (1, 1000000), (2, 5);")
    at = time.time_ns() // 1000
    time.sleep(0.01)
    s.execute("UPDATE bank SET money = 0 WHERE id = 1;")
    s.execute("DELETE FROM bank WHERE id = 2;")
    assert got(s.execute("SELECT * FROM bank;")) == [(1, 0)]
    assert got(s.execute(f"SELECT * FROM bank AS OF {at};")) == [(1, 1000000), (2, 5)]
    s.execute("CHECKPOINT;")
    assert got(s.execute(f"SELECT * FROM bank AS OF {at};")) == [(1, 1000000), (2, 5)]
    s.execute(f"RECOVER TO {at};")
    assert got(s.execute("SELECT * FROM bank;")) == [(1, 1000000), (2, 5)]


def test_constraints_and_cascade(s):
    s.execute("CREATE TABLE u (id INT PRIMARY KEY, age INT CHECK (age > 17), name VARCHAR(9) DEFAULT 'x');")
    s.execute("CREATE TABLE o (oid INT AUTO_INCREMENT, uid INT, FOREIGN KEY (uid) REFERENCES u (id) ON DELETE CASCADE);")
    s.execute("INSERT INTO u (id, age) VALUES (1, 20), (2, 30);")
    s.execute("INSERT INTO o (uid) VALUES (1), (1), (2);")
    for bad in ("INSERT INTO u VALUES (1, 40, 'a');", "INSERT INTO u VALUES (3, 4, 'a');", "INSERT INTO o (uid) VALUES (9);", "UPDATE u SET id = 2 WHERE id = 1;", "DROP TABLE u;"):
        with pytest.raises(SessionError):
            s.execute(bad)
    assert s.execute("DELETE FROM u WHERE id = 1;").count == 1
    assert got(s.execute("SELECT oid, uid FROM o;")) == [(3, 2)]
    assert "FOREIGN KEY (uid)" in s.execute("SHOW CREATE TABLE o;").data.first()[1]


def test_actions_of_updated_keys(s):
    s.execute("CREATE TABLE p (id INT PRIMARY KEY, w INT);")
    for name, action in (("c", "CASCADE"), ("e", "SET NULL"), ("r", "RESTRICT")):
        s.execute(f"CREATE TABLE {name} (k INT, pid INT, FOREIGN KEY (pid) REFERENCES p (id) ON UPDATE {action});")
    s.execute("INSERT INTO p VALUES (1, 10), (2, 20), (3, 30);")
    s.execute("INSERT INTO c VALUES (7, 1), (8, 1), (8, 1), (9, 2);")
    s.execute("INSERT INTO e VALUES (7, 1), (9, 2);")
    s.execute("INSERT INTO r VALUES (7, 3);")
    s.execute("UPDATE p SET id = 5 WHERE id = 1;")
    assert got(s.execute("SELECT k, pid FROM c;")) == [(7, 5), (8, 5), (8, 5), (9, 2)]
    assert {tuple(x) for x in s.execute("SELECT k, pid FROM e;").data.collect()} == {(7, None), (9, 2)}
    s.execute("UPDATE p SET w = 1 WHERE id = 3;")
    s.execute("BEGIN;")
    s.execute("INSERT INTO c VALUES (6, 3);")
    with pytest.raises(SessionError):
        s.execute("UPDATE p SET id = 6 WHERE id = 3;")
    s.execute("COMMIT;")
    assert got(s.execute("SELECT id, w FROM p;")) == [(2, 20), (3, 1), (5, 10)]
    assert (6, 3) in got(s.execute("SELECT k, pid FROM c;"))


def test_deletion_over_a_cycle_ends(s):
    s.execute("CREATE TABLE a (id INT PRIMARY KEY, up INT);")
    s.execute("CREATE TABLE b (id INT PRIMARY KEY, up INT, FOREIGN KEY (id) REFERENCES a (id) ON DELETE CASCADE, FOREIGN KEY (up) REFERENCES b (id) ON DELETE CASCADE);")
    s.execute("INSERT INTO a VALUES (1, 1), (2, 1), (3, 3);")
    s.execute("INSERT INTO b VALUES (1, NULL), (2, NULL), (3, NULL);")
    s.execute("UPDATE b SET up = 1 WHERE id = 1;")
    s.execute("UPDATE b SET up = 1 WHERE id = 2;")
    assert s.execute("DELETE FROM a WHERE id = 1;").count == 1
    assert [tuple(x) for x in s.execute("SELECT id, up FROM b;").data.collect()] == [(3, None)]


def test_transactions_users_and_hooks(s):
    s.execute("CREATE TABLE t (a INT);")
    s.execute("BEGIN;")
    s.execute("INSERT INTO t VALUES (1);")
    assert got(s.execute("SELECT * FROM t;")) == [(1,)]
    s.execute("ROLLBACK;")
    assert got(s.execute("SELECT * FROM t;")) == []
    s.execute("BEGIN;")
    s.execute("INSERT INTO t VALUES (2);")
    s.execute("COMMIT;")
    s.execute("CREATE USER 'ann' PASS 'pw' ROLE READONLY;")
    s.before.append(threat_veto)
    r = s.execute_batch(["INSERT INTO t VALUES (3);", "DELETE FROM t WHERE a = 9;", "LOGIN ann pw;", "INSERT INTO t VALUES (4);", "SELECT COUNT(*) AS n FROM t;"])
    assert [x.success for x in r] == [True, True, True, False, True] and r[4].data.first()[0] == 2
    assert "(1 rows)" in formats.to_text(r[4].data) and '"row_count": 1' in formats.to_json(r[4].data) and formats.to_binary(r[4].data)[0] == 2


def test_script_and_values(s, spark):
    r = s.run_script("CREATE TABLE v (a INT, b DECIMAL, c BOOLEAN, d TIMESTAMP); -- note\n/* x */ INSERT INTO v VALUES (1, 2, 'yes', '13/01/2026');")
    assert all(x.success for x in r), r
    assert coerce("7", "INT") == 7 and coerce(True, "VARCHAR") == "true" and as_of_micros("1") == 1_000_000
    assert got(s.execute("SELECT a FROM v WHERE b = 2.00001 AND d >= '2026-01-13';")) == [(1,)]


def test_times_before_an_alter_are_kept(s):
    s.execute("CREATE TABLE box (id INT PRIMARY KEY, tag VARCHAR(9));")
    s.execute("INSERT INTO box VALUES (1, 'a'), (2, 'b');")
    at = time.time_ns() // 1000
    time.sleep(0.01)
    s.execute("ALTER TABLE box ADD size INT;")
    s.execute("DELETE FROM box WHERE id = 2;")
    assert got(s.execute("SELECT id, tag FROM box;")) == [(1, "a")]
    assert sorted(r.id for r in s.execute(f"SELECT * FROM box AS OF {at};").data.collect()) == [1, 2]
    s.execute(f"RECOVER TO {at};")
    assert got(s.execute("SELECT id, tag FROM box;")) == [(1, "a"), (2, "b")]


def test_a_commit_over_two_tables_is_whole_or_nothing(s, spark):
    other = Session(spark, s.root)
    for t in ("left_one", "right_one"):
        s.execute(f"CREATE TABLE {t} (a INT);")
    s.execute("BEGIN;")
    s.execute("INSERT INTO left_one VALUES (1);")
    s.execute("INSERT INTO right_one VALUES (1);")
    other.execute("INSERT INTO right_one VALUES (9);")
    assert got(s.execute("SELECT * FROM right_one;")) == [(1,)]  # one version all through
    with pytest.raises(ConflictError):
        s.execute("COMMIT;")
    assert got(s.execute("SELECT * FROM left_one;")) == [] and got(s.execute("SELECT * FROM right_one;")) == [(9,)]


def test_an_intent_left_by_a_dead_writer_is_finished(s, spark):
    for t in ("left_one", "right_one"):
        s.execute(f"CREATE TABLE {t} (a INT PRIMARY KEY);")
    s.execute("BEGIN;")
    s.execute("INSERT INTO left_one VALUES (1);")
    s.execute("INSERT INTO right_one VALUES (2);")
    journal, finish = s._journal(), Journal._finish
    try:
        Journal._finish = lambda self, intent: None
        s.execute("COMMIT;")
    finally:
        Journal._finish = finish
    assert journal.files.exists(journal.path)
    assert got(Session(spark, s.root).execute("SELECT * FROM right_one;")) == [(2,)] and got(s.execute("SELECT * FROM left_one;")) == [(1,)]
    with pytest.raises(SessionError):
        s.execute("INSERT INTO left_one VALUES (1);")


def test_comment_signs_inside_strings_stay(s):
    r = s.run_script("CREATE TABLE note (t VARCHAR(20)); INSERT INTO note VALUES ('a--b#c'); -- the end")
    assert all(x.success for x in r) and got(s.execute("SELECT t FROM note;")) == [("a--b#c",)]


def test_commands_ask_for_rights(s):
    s.execute("CREATE TABLE t (a INT);")
    may = {
        "SUPERADMIN": {"SHOW USER;", "CHECKPOINT;", "DESCRIBE t;", "SHOW TABLES;", "BEGIN;", "WHOAMI;"},
        "ADMIN": {"CHECKPOINT;", "DESCRIBE t;", "SHOW TABLES;", "BEGIN;", "WHOAMI;"},
        "NORMAL": {"DESCRIBE t;", "SHOW TABLES;", "BEGIN;", "WHOAMI;"},
        "READONLY": {"DESCRIBE t;", "SHOW TABLES;", "WHOAMI;"},
        "DENIED": {"WHOAMI;"},
    }
    for role in may:
        s.execute(f"CREATE USER '{role}' PASS 'pw' ROLE {role};")
    for role, allowed in may.items():
        s.execute(f"LOGIN '{role}' 'pw';")
        for text in may["SUPERADMIN"]:
            if text in allowed:
                s.execute(text)
                s.txn = None
            else:
                with pytest.raises(SessionError):
                    s.execute(text)
