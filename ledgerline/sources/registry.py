"""Table sources by driver name. A source loads a table anew on every call."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

GROUP = "ledgerline.sources"


class Source:
    """``load(table)`` gives a DataFrame; ``columns`` its names in lower case, sorted."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load(self, table: str) -> DataFrame:
        raise NotImplementedError

    def columns(self, table: str) -> list[str]:
        return sorted(c.lower() for c in self.load(table).columns)

    def close(self) -> None:
        """Nothing is held open."""


class Memory(Source):
    """Tables given as DataFrames, or as lists of dicts with a schema."""

    def __init__(self, spark: SparkSession, tables: dict | None = None, schemas: dict | None = None):
        super().__init__(spark)
        self.tables, self.schemas = tables or {}, schemas or {}

    def load(self, table: str) -> DataFrame:
        found = self.tables[table]
        return found if isinstance(found, DataFrame) else self.spark.createDataFrame(found, self.schemas.get(table))


class Files(Source):
    """A folder of tables, or a table's own path, in a file format that Spark reads."""

    def __init__(self, spark: SparkSession, format: str = "parquet", path: str | None = None, **options):
        super().__init__(spark)
        self.format, self.path, self.options = format, path, options

    def load(self, table: str) -> DataFrame:
        suffix = "" if "." in table.rsplit("/", 1)[-1] else f".{self.format}"
        path = table if self.path is None else f"{self.path.rstrip('/')}/{table}{suffix}"
        return self.spark.read.format(self.format).options(**self.options).load(path)


class Catalog(Source):
    """Tables and views of the session's catalog."""

    def load(self, table: str) -> DataFrame:
        return self.spark.table(table)


class Jdbc(Source):
    """Tables over JDBC; the driver's jar must be on the class path. ``partition_column`` with
    bounds and ``num_partitions`` makes the read parallel."""

    def __init__(self, spark: SparkSession, url: str | None = None, **options):
        super().__init__(spark)
        self.options = {"url": url or "", **options}

    def load(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options, dbtable=table).load()


class Postgres(Jdbc):
    def __init__(self, spark: SparkSession, host="localhost", port=5432, user=None, password=None, dbname="", dsn=None, **options):
        own = {k: v for k, v in {"user": user, "password": password, "driver": "org.postgresql.Driver"}.items() if v}
        super().__init__(spark, dsn if dsn and dsn.startswith("jdbc:") else f"jdbc:postgresql://{host}:{port}/{dbname}", **own, **options)


class DuckDb(Jdbc):
    def __init__(self, spark: SparkSession, path: str = "", **options):
        super().__init__(spark, f"jdbc:duckdb:{path}", driver="org.duckdb.DuckDBDriver", **options)


class Snowflake(Source):
    """Through the Snowflake connector for Spark, which must be on the class path."""

    NAMES = {"account": "sfURL", "user": "sfUser", "password": "sfPassword", "warehouse": "sfWarehouse", "database": "sfDatabase", "schema": "sfSchema", "role": "sfRole"}

    def __init__(self, spark: SparkSession, **params):
        super().__init__(spark)
        self.options = {self.NAMES.get(k, k): f"{v}.snowflakecomputing.com" if k == "account" else v for k, v in params.items() if v is not None}

    def load(self, table: str) -> DataFrame:
        return self.spark.read.format("snowflake").options(**self.options, dbtable=table).load()


def _files(kind: str) -> Callable[..., Source]:
    return lambda spark, **params: Files(spark, format=kind, **params)


BUILT_IN: dict[str, Callable[..., Source]] = {
    "memory": Memory, "table": Catalog, "jdbc": Jdbc, "postgres": Postgres, "duckdb": DuckDb, "snowflake": Snowflake,
    **{kind: _files(kind) for kind in ("parquet", "csv", "json", "orc")},
}


def _plugins() -> dict:
    return {e.name: e for e in entry_points(group=GROUP)}


def available_drivers() -> list[str]:
    return sorted({*BUILT_IN, *_plugins()})


def source_class(driver: str) -> Callable[..., Source]:
    """Entry points come before what is built in."""
    if driver in (found := _plugins()):
        return found[driver].load()
    if driver in BUILT_IN:
        return BUILT_IN[driver]
    raise KeyError(f"unknown driver {driver!r}; available: {', '.join(available_drivers())}")
