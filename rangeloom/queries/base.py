"""Helpers of the query modules: registration, the derived frames and their SQL."""

from __future__ import annotations

from ..sources import derived
from ..sources.derived import customer_ranges, event_points, line_ranges, order_ranges, part_ranges, quantity_lists, table

O, L, P, Q, T = order_ranges, line_ranges, event_points, quantity_lists, table
C, K = customer_ranges, part_ranges
#: Spaces of the frames of the pair-returning joins: so many that the hits grow with the tables and not with their square.
FOLD = 997

#: The derived frames as common table expressions with short column names.
FRAMES = {
    "o": 'o AS MATERIALIZED (SELECT space, rid, start AS s, "end" AS e FROM (' + derived.SQL["order_ranges"] + "))",
    "l": 'l AS MATERIALIZED (SELECT space, rid, start AS s, "end" AS e, weight AS w FROM (' + derived.SQL["line_ranges"] + "))",
    "p": 'p AS MATERIALIZED (SELECT space, rid, start AS s, "end" AS e FROM (' + derived.SQL["event_points"] + "))",
    "c": 'src AS MATERIALIZED (SELECT space, rid, start AS s, "end" AS e FROM (' + derived.SQL["customer_ranges"] + "))",
    "a": f'a AS MATERIALIZED (SELECT space % {FOLD} AS space, rid, start AS s, "end" AS e FROM (' + derived.SQL["customer_ranges"] + "))",
    "b": f'b AS MATERIALIZED (SELECT space % {FOLD} AS space, rid, start AS s, "end" AS e, weight AS w FROM (' + derived.SQL["part_ranges"] + "))",
    "q": "q AS MATERIALIZED (" + derived.SQL["quantity_lists"] + ")",
}


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query, sql: str | None = None, frames: str = "o", more: str = "", recursive: bool = False) -> None:
        """Register a query and the SQL that checks it: ``sql`` over the frames named in ``frames`` and the further
        expressions in ``more``."""
        self.queries[name] = query
        if sql is not None:
            parts = [FRAMES[f] for f in frames] + ([more] if more else [])
            self.oracles[name] = (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + sql
