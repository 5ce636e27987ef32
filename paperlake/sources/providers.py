"""Providers of bibliographic records: tables of works, found by DOI, file name or title.

A provider is a function that gives a DataFrame (title, authors, year, doi, …); a dump of a
service is read by ``repairs.from_dump``. Nothing is asked over a network from an executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlake.operators.repairs import from_dump

Provider = Callable[[SparkSession], DataFrame]
PROVIDERS: dict[str, Provider] = {}
# Other names of providers.
ALIASES = {"semantic-scholar": "semantic_scholar", "s2": "semantic_scholar"}


def register(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def register_dump(name: str, path: str, form: str = "json") -> None:
    """A provider that reads nested works of a dump."""
    register(name, lambda spark: from_dump(spark.read.format(form).load(path)))


def get(spark: SparkSession, name: str) -> tuple[str, DataFrame]:
    """(the provider's own name, its records); an unknown name is refused."""
    name = ALIASES.get(name, name)
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; known: {', '.join(sorted(PROVIDERS)) or 'none'}")
    return name, PROVIDERS[name](spark)
