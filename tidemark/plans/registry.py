"""Where query modules register their queries with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Decorator: registers a function (spark, folder) -> DataFrame under its name."""

        def add(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add
