"""Landed tables: explicit schemas, typed reads, idempotent snapshot writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _S, _D, _I, _T = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SCHEMAS = {
    "region": _schema(r_regionkey=_I, r_name=_S),
    "nation": _schema(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "customer": _schema(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "supplier": _schema(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "part": _schema(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "orders": _schema(o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_T, o_orderpriority=_S),
    "lineitem": _schema(l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D, l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S, l_shipdate=_T),
    "events": _schema(event_id=_L, ts=_T, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": _schema(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "labels": _schema(doc_id=_L, quality=_I, toxic=_I),
    "conversations": _schema(conv_id=_L, turn=_L, role=_S, text=_S),
    "embeddings": _schema(vec_id=_L, embedding=T.ArrayType(T.FloatType()), label=_I),
}

#: The common schemas of the engine's entities.
ENTITIES = {
    "channels": _schema(channel_id=_S, title=_S, niche=_S),
    "videos": _schema(video_id=_S, channel_id=_S, title=_S, published_at=T.TimestampType()),
    "channel_snapshots": _schema(channel_id=_S, snapshot_week=T.DateType(), subscribers=_L, views=_L),
    "video_snapshots": _schema(video_id=_S, channel_id=_S, snapshot_week=T.DateType(), views=_L, likes=_L, comments=_L),
    "comments": _schema(comment_id=_S, video_id=_S, commenter_hash=_S, text=_S, published_at=T.TimestampType()),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table under spark.checkpoint.dir, the folder that driver and executors share (a temporary one in local runs): what comes
    after is planned without what came before, and what is read several times is computed once."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = settled.own = getattr(settled, "own", None) or "file://" + tempfile.mkdtemp(prefix="tessera-")
    at = f"{at.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def read_landed(spark: SparkSession, path: str, entity: str, form: str = "json") -> DataFrame:
    """Landed API responses as typed rows; a row that isn't of the schema stops the read."""
    reader = spark.read.schema(ENTITIES[entity])
    return reader.option("mode", "FAILFAST").json(path) if form == "json" else reader.parquet(path)


def write_snapshot(df: DataFrame, path: str, week: str = "snapshot_week") -> None:
    """Appends weeks; a week that is written again replaces itself. Columns that name commenters are refused."""
    refuse_commenters(df)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(week).parquet(path)


def refuse_commenters(df: DataFrame) -> DataFrame:
    bad = [c for c in df.columns if "commenter" in c.lower() and ("hash" in c.lower() or "id" in c.lower())]
    if bad:
        raise ValueError(f"an output may not identify commenters: {bad}")
    return df


def validated(df: DataFrame, entity: str) -> DataFrame:
    """df, if it has the entity's columns and types."""
    want, got = {f.name: f.dataType for f in ENTITIES[entity]}, {f.name: f.dataType for f in df.schema}
    if want != got:
        raise ValueError(f"{entity}: {sorted(set(want.items()) ^ set(got.items()), key=str)}")
    return df
