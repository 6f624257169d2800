"""Registered queries and the shared SQL blocks their checks are made of."""

from __future__ import annotations

from touchline.plans.blocks import BLOCKS

QUERIES: dict = {}
ORACLES: dict = {}


def with_blocks(body: str, *names: str) -> str:
    """``body`` below the named SQL blocks and everything they need, in dependency order."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for other in BLOCKS[name][0]:
            need(other)
        ordered.append(name)

    for name in names:
        need(name)
    head = ",\n".join(f"{n} AS {BLOCKS[n][2] if len(BLOCKS[n]) > 2 else ''}({BLOCKS[n][1]})" for n in ordered)
    body = body.strip()
    if body[:5].split()[0].upper() == "WITH":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None, blocks: tuple = ("matches",)):
    """Register a (spark, folder) -> DataFrame function, with the SQL it must agree with."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_blocks(sql, *blocks) if blocks else sql
        return function

    return add
