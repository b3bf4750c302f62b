"""Query registration, table access and the two SQL dialects the stand-in tables are written in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


class Given:
    """The given tables as attributes, read on first use, and stand-in tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}
        self._derived: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def derive(self, template: Callable[[Dialect], str]) -> DataFrame:
        if template.__name__ not in self._derived:
            text = template(SPARK)
            used = {name: getattr(self, name) for name in TABLES if "{" + name + "}" in text}
            self._derived[template.__name__] = self.spark.sql(text, **used)
        return self._derived[template.__name__]


@dataclass(frozen=True)
class Dialect:
    """The few functions whose spelling differs between the engines."""

    name: str

    def plus(self, ts: str, unit: str, n: str) -> str:
        if self.name == "spark":
            return f"timestampadd({unit}, CAST({n} AS INT), {ts})"
        return f"({ts} + to_{unit.lower()}s(CAST({n} AS INTEGER)))"

    def time_text(self, ts: str) -> str:
        if self.name == "spark":
            return f"left(CAST({ts} AS STRING), 19)"
        return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def duck(template: Callable[[Dialect], str]) -> str:
    """A stand-in template as DuckDB text over the registered views."""
    return template(DUCK).format(**{name: name for name in TABLES})


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Given], DataFrame]
    oracle: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Given(spark, folder))


REGISTRY: dict[str, Query] = {}


def register(name: str, build: Callable[[Given], DataFrame], oracle: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name} is already registered")
    REGISTRY[name] = Query(name, build, oracle)


def query(name: str, oracle: str | None = None):
    """Register the decorated builder together with its SQL statement."""

    def add(build: Callable[[Given], DataFrame]):
        register(name, build, oracle)
        return build

    return add
