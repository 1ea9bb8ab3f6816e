"""Registration of queries with their SQL."""

from __future__ import annotations

from .worldviews import World, oracle


class Plans:
    """Collects queries; use as a decorator factory: plans("name", sql)."""

    def __init__(self):
        self.functions, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def register(f):
            self.functions[name] = lambda spark, sf_dir: f(World(spark, sf_dir))
            if sql is not None:
                self.sql[name] = oracle(sql)
            return f

        return register

    def queries(self):
        return dict(self.functions)

    def oracle_sql(self):
        return dict(self.sql)
