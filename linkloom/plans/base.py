"""How plans register queries: name, function of (spark, sf_dir), and an oracle's SQL or None."""

from __future__ import annotations

from collections.abc import Callable


class Plans:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep
