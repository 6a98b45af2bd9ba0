"""Registry of the queries outside the optional subpackages."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under `name`, with its SQL if there is one."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    from recordloom.plans import catalogue  # noqa: F401  registers on import

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from recordloom.plans import catalogue  # noqa: F401

    return dict(_ORACLES)
