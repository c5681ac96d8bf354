"""What the registered queries share: the registry itself and the tables they derive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.plans.schemas import FIELDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: lineitem repeats line numbers within an order; a line's place among the order's lines, by these columns, tells them apart.
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_PLACE = f"cast(row_number() over (partition by l_orderkey order by {_ORDER}) as int)"
LINES_SQL = f"(select * replace ({_PLACE} as l_linenumber) from lineitem) as lines"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, with DuckDB SQL for the same rows. lineitem's rows there have their places as line numbers."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql.replace("from lineitem", f"from {LINES_SQL}")
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of lineitem, with its place among its order's lines as l_linenumber."""
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.expr(_PLACE))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The same rows over all cores where the source has fewer splits than those; larger sources are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if len(rows.inputFiles()) < cores else rows


def campos(**given: Column) -> Column:
    """The fields of a citation, null where they aren't given."""
    return F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FIELDS.fields))
