"""Extension points: source adapters and scorers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.sources.contracts import at_rest, require

Adapter = Callable[[SparkSession, str], DataFrame]
_adapters: dict[str, Adapter] = {}


def register_adapter(name: str, adapter: Adapter) -> None:
    """An adapter turns a raw location into the aggregate table."""
    _adapters[name] = adapter


def read_with(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Run an adapter and hold its result to the entry and exit contracts."""
    return at_rest(require(_adapters[name](spark, path), non_empty=False))
