"""Key -> query and key -> SQL, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .fixtures import Inputs, flat

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")

        def run(spark, sf_dir):
            return flat(build(Inputs(spark, sf_dir)))

        run.__name__, run.__doc__ = key, build.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register
