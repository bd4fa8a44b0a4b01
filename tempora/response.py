"""What a session does about hostile statements and unusual writing: veto, block, recover."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import functions as F

from tempora.functions.scalar import micros
from tempora.operators import analytics
from tempora.session import Session, threat_level

#: Fixed values, in microseconds: nothing is done before the first; a recovery goes back by the second and is not repeated within the third.
WARM_UP, LOOK_BACK, COOL_DOWN = 30_000_000, 60_000_000, 60_000_000
SYSTEM = "sys_"


class Guard:
    """Watches a session once made: its statements before they run, and its log whenever ``analyse`` is called.

    A statement of medium threat or more is refused, and its table and user are blocked. Unusual rates: LOW is only noted, MEDIUM blocks the table,
    HIGH takes the database back to a minute before and unblocks the table. Text alone never takes the database back, whatever its threat, since
    anyone who may read could then undo others' work. Tables whose names begin with ``sys_`` are left alone.
    """

    def __init__(self, session: Session, clock: Callable[[], int] = lambda: time.time_ns() // 1000):
        self.session, self.clock, self.start = session, clock, clock()
        self.tables: set[str] = set()
        self.users: set[str] = set()
        self.cool: dict[str, int] = {}
        self.notes: list[tuple[int, str, str, str]] = []
        session.before.append(self.allow)

    def allow(self, kind: str, table: str, text: str) -> bool:
        if table.startswith(SYSTEM):
            return True
        level = threat_level(text)
        if level != "NONE":
            self.notes.append((self.clock(), level, table, self.session.user))
        if level in ("MEDIUM", "HIGH"):
            self._block(table, self.session.user)
            return False
        return kind == "SELECT" or (table not in self.tables and self.session.user not in self.users)

    def cooling(self, table: str) -> bool:
        return self.clock() < self.cool.get(table, 0)

    def unblock(self, table: str | None = None, user: str | None = None) -> None:
        self.tables.discard(table)
        self.users.discard(user)

    def _block(self, table: str, user: str) -> None:
        if not self.cooling(table) and table not in self.tables:
            self.tables.add(table)
            if user:
                self.users.add(user)

    def respond(self, level: str, table: str, user: str = "", at: int | None = None) -> None:
        """Acts on unusual writing seen at a time in microseconds. If the recovery fails, the table stays blocked and the error is raised."""
        at = self.clock() if at is None else at
        self.notes.append((at, level, table, user))
        if level == "MEDIUM":
            self._block(table, user)
        elif level == "HIGH" and not self.cooling(table):
            self.tables.add(table)
            if user:
                self.users.add(user)
            self.session.recover(at - LOOK_BACK)
            self.tables.discard(table)
            self.cool[table] = self.clock() + COOL_DOWN

    def analyse(self) -> list[tuple[str, str]]:
        """Responds to the tables whose rate in the last minute is unusual: (table, severity), one row a table at most. A log that has rested for
        a minute has no current rate."""
        now = self.clock()
        if now - self.start < WARM_UP:
            return []
        log = self.session.mutations().filter(~F.col("table").startswith(SYSTEM))
        last = log.agg(F.max(micros(F.col("ts")))).first()[0]
        if last is None or now - last > analytics.MINUTE:
            return []
        found = analytics.anomalies(analytics.dense_rates(log, "table", F.lit(1)), "table").filter("severity <> 'NONE'").select("table", "severity").collect()
        out = sorted((t, level) for t, level in found if not self.cooling(t))
        for table, level in out:
            self.respond(level, table, at=now)
        return out
