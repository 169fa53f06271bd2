"""How check modules register their queries."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name, each with its SQL where SQL can run it at full size."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def keep(fn: Callable) -> Callable:
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return keep
