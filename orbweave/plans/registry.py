"""A module's queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.calls: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.calls[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
