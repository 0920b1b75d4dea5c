"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from loglantern.plans.views import Logs


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        def register(build):
            self.queries[name] = lambda spark, folder: build(Logs(spark, folder))
            if oracle is not None:
                self.oracle[name] = oracle
            return build

        return register
