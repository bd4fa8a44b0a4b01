"""Words, numbers, strings and symbols of the dialect, and the two vocabularies of its keywords."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: For each concept the words that say it, in either vocabulary.
VOCABULARY = """
SELECT: SELECT 2E5TAR
FROM: FROM MEN
WHERE: WHERE LAMA
INSERT: INSERT EMLA
INTO: INTO GOWA
VALUES: VALUES ELKEYAM
UPDATE: UPDATE 3ADEL
SET: SET 5ALY
DELETE: DELETE 2EMSA7
CREATE: CREATE 2E3MEL
DROP: DROP
ALTER: ALTER
TABLE: TABLE GADWAL
DATABASE: DATABASE
DATABASES: DATABASES
INDEX: INDEX FEHRIS
USE: USE 2ESTA5DEM
LOGIN: LOGIN
USER: USER MOSTA5DEM 3ABD
ROLE: ROLE WAZEFA DOWR
PASS: PASSWORD PASS
SHOW: SHOW WARENY
WHOAMI: WHOAMI ANAMEEN
STATUS: STATUS 7ALAH
DESCRIBE: DESCRIBE DESC WASF
ADD: ADD ADAF
RENAME: RENAME GHAYER_ESM
COLUMN: COLUMN 3AMOD
SUPERADMIN: SUPERADMIN
ADMIN: ADMIN MODEER
NORMAL: NORMAL 3ADI
READONLY: READONLY MOSHAHED
DENIED: DENIED MAMNO3
INT: INT INTEGER RAKAM
BIGINT: BIGINT
VARCHAR: VARCHAR TEXT STRING GOMLA
BOOLEAN: BOOL BOOLEAN
TIMESTAMP: DATE DATETIME TARE5 TIMESTAMP
DECIMAL: DECIMAL FLOAT DOUBLE KASR
TRUE: TRUE AH
FALSE: FALSE LA
AND: AND WE
OR: OR AW
IN: IN FE
LIKE: LIKE
ON: ON 3ALA
PRIMARY: PRIMARY ASASI
KEY: KEY MOFTA7
BEGIN: BEGIN START 2EBDA2
COMMIT: COMMIT 2AKED
ROLLBACK: ROLLBACK 2ERGA3 UNDO
CHECKPOINT: CHECKPOINT SAVE
RECOVER: RECOVER ERGA3
TO: TO ELA
LATEST: LATEST A5ER ASLHA
NOW: NOW DELWA2TY
CURRENT: CURRENT 7ALY
AS: AS K
OF: OF
IF: IF LAW
EXISTS: EXISTS MAWGOOD
GROUP: GROUP MAGMO3A
BY: BY B
HAVING: HAVING ETHA LAKEN
COUNT: COUNT 3ADD
SUM: SUM MAG3MO3
AVG: AVG AVERAGE MOTOWASET
MIN: MIN ASGAR
MAX: MAX AKBAR
ORDER: ORDER RATEB
ASC: ASC ASCENDING TASE3DI TALE3
DESC: DESC DESCENDING TANAZOLI NAZL
LIMIT: LIMIT 7ADD
OFFSET: OFFSET SKIP EBDA2MEN
DISTINCT: DISTINCT MOTA3MEZ
ALL: ALL KOL
JOIN: JOIN ENTEDAH
INNER: INNER DA5ELY
LEFT: LEFT SHMAL
RIGHT: RIGHT YAMEN
OUTER: OUTER 5AREGY
FULL: FULL
CROSS: CROSS TAQATE3
FOREIGN: FOREIGN
REFERENCES: REFERENCES YOSHEER
CASCADE: CASCADE TATABE3
RESTRICT: RESTRICT MANE3
NO: NO
ACTION: ACTION E3RA2
NULL: NULL FADY
NOT: NOT MESH
DEFAULT: DEFAULT EFRADY
UNIQUE: UNIQUE WAHED
CHECK: CHECK FA7S
AUTO_INCREMENT: AUTO_INCREMENT AUTOINCREMENT SERIAL TAZAYED
AI: AI ZAKA2
ANOMALIES: ANOMALIES SHOZOOZ
EXECUTION: EXECUTION TANFEEZ
STATS: STATS E7SA2EYAT
STOP: STOP WA2AF SHUTDOWN 2AFOL
TRUNCATE: TRUNCATE
"""

CONCEPTS: dict[str, frozenset[str]] = {}
for _line in VOCABULARY.split("\n"):
    _concept, _, _words = _line.partition(":")
    for _word in _words.split():
        CONCEPTS[_word] = CONCEPTS.get(_word, frozenset()) | {_concept}

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<str>'[^']*')
  | (?P<word>(?=[0-9_]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9_]*)
  | (?P<num>-?\d+(?:\.\d+)?)
  | (?P<sym><=|>=|<>|!=|[=<>(),;*.])
  )""",
    re.VERBOSE,
)


class DialectError(ValueError):
    """A text that is no statement of the dialect."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    def says(self, concept: str) -> bool:
        """Keywords are known by their place, so a column may be called b or k."""
        return self.kind == "word" and concept in CONCEPTS.get(self.text.upper(), ())


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        if not (m := _TOKEN.match(text, at)):
            raise DialectError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        kind = m.lastgroup
        value = m.group(kind)
        out.append(Token(kind, value[1:-1] if kind == "str" else value, m.start(kind)))
        at = m.end()
    out.append(Token("end", "", at))
    return out
