"""Registry of named queries: Spark builder + DuckDB oracle text.

``@query(name, oracle=..., views=(...))`` registers a function
``f(fx: Fixtures) -> DataFrame``. The public callables take
``(spark, sf_dir)`` as the driver contract requires.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..sources.fixtures import Fixtures
from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DOCS: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = (),
          extra_views: dict | None = None):
    def deco(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Fixtures(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DOCS[name] = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views, extra=extra_views)
        return fn
    return deco
