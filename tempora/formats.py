"""Results as text, JSON and bytes, for the edge where rows leave Spark."""

from __future__ import annotations

import json
import struct
from typing import Any

from pyspark.sql import DataFrame


def cell(v: Any) -> str:
    """A value as the protocol writes it: doubles with six digits, booleans as 1 and 0."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df: DataFrame, cap: int = 1000) -> tuple[list[str], list[list[str]], bool]:
    """(columns, cells, truncated): at most `cap` rows, and whether there are more."""
    got = df.limit(cap + 1).collect()
    return df.columns, [[cell(v) for v in r] for r in got[:cap]], len(got) > cap


def to_text(df: DataFrame, cap: int = 1000) -> str:
    columns, cells, _ = rows(df, cap)
    width = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, width)) + " |"
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    return "\n".join([rule, line(columns), rule, *map(line, cells), rule, f"({len(cells)} rows)"])


def to_json(df: DataFrame, cap: int = 1000) -> str:
    columns, cells, more = rows(df, cap)
    return json.dumps({"success": True, "data": {"columns": columns, "rows": cells}, "row_count": len(cells), "truncated": more})


def to_binary(df: DataFrame, cap: int = 1000) -> bytes:
    """Tag 2, then big-endian lengths: columns, rows, and each text with its length."""
    columns, cells, _ = rows(df, cap)
    put = lambda t: struct.pack(">i", len(b := t.encode())) + b
    return b"\x02" + struct.pack(">ii", len(columns), len(cells)) + b"".join(map(put, columns)) + b"".join(put(v) for r in cells for v in r)


def message(text: str, error: bool = False) -> bytes:
    return (b"\xff" if error else b"\x01") + struct.pack(">i", len(b := text.encode())) + b
