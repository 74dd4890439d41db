"""Put the CTEs a query needs in front of it."""

from __future__ import annotations

import re

from oracles.bridge import BRIDGE
from oracles.changes import COMMANDS, CHANGE_SQL
from oracles.reads import READ_SQL
from oracles.shapes import SHAPES

_CTES = {**BRIDGE, **SHAPES, **COMMANDS}


def _mentioned(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [name for name in _CTES if name in words]


def with_ctes(sql: str) -> str:
    needed: set[str] = set()
    todo = _mentioned(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += _mentioned(_CTES[name])
    # The CTEs are listed so that each one only uses those before it.
    head = ",\n".join(f"{name} AS ({_CTES[name].strip()})" for name in _CTES if name in needed)
    return f"WITH RECURSIVE {head}\n{sql.strip()}" if head else sql.strip()


def all_sql() -> dict[str, str]:
    return {key: with_ctes(sql) for key, sql in {**READ_SQL, **CHANGE_SQL}.items()}
