"""The source interface and the registry."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from tokentally.sources.files import Options


class Source(Protocol):
    name: str

    def paths(self) -> list[str]: ...

    def available(self) -> bool: ...

    def read(self, spark: SparkSession, options: Options | None = None, paths: list[str] | None = None) -> DataFrame: ...


_FACTORIES: dict[str, Callable[[], Source]] = {}


def register(name: str, make: Callable[[], Source]) -> None:
    _FACTORIES[name] = make


def names() -> list[str]:
    return sorted(_FACTORIES)


def get(name: str) -> Source:
    if name not in _FACTORIES:
        raise KeyError(f"unknown agent {name!r}; known: {', '.join(names())}")
    return _FACTORIES[name]()


def get_all() -> list[Source]:
    return [get(n) for n in names()]
