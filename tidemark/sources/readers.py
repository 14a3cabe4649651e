"""Sources and sinks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The raw clickstream's columns and the type each must parse as.
RAW = {"event_time": "timestamp", "event_type": "string", "product_id": "bigint", "category_id": "bigint", "category_code": "string", "brand": "string", "price": "double", "user_id": "bigint", "user_session": "string"}
#: Text form of event_time: seconds, then a zone name.
TIME = "yyyy-MM-dd HH:mm:ss z"


def read_raw_csv(spark: SparkSession, paths: str) -> DataFrame:
    """Headed CSV files -> typed rows; a row with a field that doesn't parse is dropped.

    All fields are read as text and tested by explicit casts, so the rows that stay don't depend on
    which columns a query reads (as they do in the reader's own DROPMALFORMED mode).
    """
    raw = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in RAW)).csv(paths)
    typed = {c: F.try_to_timestamp(F.col(c), F.lit(TIME)) if t == "timestamp" else F.col(c).try_cast(t) for c, t in RAW.items()}
    fine = F.lit(True)
    for c, t in RAW.items():
        if t not in ("string",) and c != "category_id":  # category_id is never used further on
            fine = fine & (F.col(c).isNull() | typed[c].isNotNull())
    return raw.where(fine).select(*[typed[c].alias(c) for c in RAW])


def read_profile_csv(spark: SparkSession, paths: str) -> DataFrame:
    """S3: headed CSV -> (event_time timestamp, event_type)."""
    return spark.read.option("header", True).csv(paths).select(F.try_to_timestamp("event_time", F.lit(TIME)).alias("event_time"), "event_type")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S13"""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as a clickstream with blanks, nulls, odd types and repeats to clean."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.selectExpr(
        "case when o_custkey % 97 = 5 then null else o_custkey end as user_id",
        "l_partkey as product_id",
        "case when l_linenumber = 7 then 'error' when l_returnflag = 'N' then 'view' when l_returnflag = 'A' then 'cart' else 'purchase' end as event_type",
        "cast(o_orderdate as timestamp) as event_time",
        "l_extendedprice as price",
        "case l_linenumber when 1 then lower(o_orderpriority) when 2 then concat(lower(o_orderpriority), '.', lower(l_linestatus), '.x') when 3 then '' when 4 then null else concat(lower(o_orderpriority), '.', lower(l_linestatus)) end as category_code",
        "case when l_partkey % 11 = 3 then null when l_partkey % 13 = 5 then '  ' when l_suppkey % 3 = 1 then concat(' SUPPLIER#', cast(l_suppkey as string), ' ') else concat('supplier#', cast(l_suppkey as string)) end as brand",
        "case when o_orderkey % 10 = 3 then '' when o_orderkey % 10 = 7 then null else cast(o_orderkey as string) end as user_session",
    )


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a clickstream."""
    return table(spark, sf_dir, "events").selectExpr("user_id", "cast(get_json_object(props, '$.k') as bigint) as product_id", "case event_type when 'click' then 'cart' else event_type end as event_type", "cast(ts as timestamp) as event_time", "value as price", "cast(null as string) as category_code", "cast(null as string) as brand", "cast(null as string) as user_session")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and one machine does all (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def write_tables(tables: dict[str, DataFrame], folder: str, partitions: dict[str, list[str]] | None = None) -> None:
    """One Parquet dataset per table; edges by relation instead of array files."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partitions or {}).get(name, [])).parquet(f"{folder}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    """Vocabularies, node counts, metrics."""
    df.write.mode("overwrite").json(path)
