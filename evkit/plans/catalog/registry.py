"""Registration of queries with their SQL equivalents, and access to the test tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# Declared, so that opening a table starts no job to read its schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


class Tables:
    """The Parquet tables of one folder, opened by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None) -> Callable:
    """Register a function under its name; `ids` are the operators it exercises."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} is registered twice")
        REGISTRY[fn.__name__] = Query(fn, sql, tuple(ids.split()))
        return fn

    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return REGISTRY[name].run(Tables(spark, folder))

    return run
