"""Shared plumbing: reading tables, cutting lineage, size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word and text rules here: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: A set of identifiers up to this many bytes may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's, or, with local executors only, one of our own.

    Raises RuntimeError on a cluster that names none, since a folder of the driver's would serve nobody."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="textquarry-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textquarry/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that this application has written; results that read them are void afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that go to a Python worker at a time: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep batches of texts small in this session, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bucket_crc(doc_id: str, mod: int) -> Column:
    """crc32 of the identifier as text, modulo mod; null identifiers give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


#: Stands for a missing identifier where rows are told apart.
NO_ID = (1 << 63) - 1


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, changed where a column (in any case) has one already."""
    taken = {c.lower() for c in columns}
    return [next(x for x in (n, *(f"{n}_{i}" for i in range(len(taken) + 1))) if x.lower() not in taken) for n in names]


def with_row_key(docs: DataFrame, key: Column, id_name: str, key_name: str) -> DataFrame:
    """docs with what tells its rows apart: the identifier (NO_ID for none) and a hash."""
    return docs.withColumns({id_name: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key_name: key})


def join_rows(docs: DataFrame, rows: DataFrame, key: Column, how: str) -> DataFrame:
    """docs' rows that are (left_semi) or are not (left_anti) among rows (did, key: as
    with_row_key makes them of docs).  rows goes to every executor only if its counted
    size is below BROADCAST_BYTES; otherwise both sides are shuffled."""
    d, k = fresh(docs.columns, "row_id", "row_key")
    rows = rows.select(F.col("did").alias(d), F.col("key").alias(k))
    if rows.count() * 48 <= BROADCAST_BYTES:
        rows = F.broadcast(rows)
    return with_row_key(docs, key, d, k).join(rows, [d, k], how).select(*docs.columns)


def text_key() -> Column:
    return F.xxhash64(F.lit("text"), "text")


def without_rows(docs: DataFrame, rows: DataFrame, key: Column | None = None) -> DataFrame:
    """docs less the rows among rows (did, key); key is by default that of the text."""
    return join_rows(docs, rows, text_key() if key is None else key, "left_anti")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs less the rows whose key is in ids.  ids goes to every executor only if
    its counted size is below BROADCAST_BYTES; otherwise both sides are shuffled."""
    ids = ids.select(key)
    if ids.count() * 48 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return docs.join(ids, key, "left_anti").select(*docs.columns)


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs' rows whose key is in ids; the same size check as without()."""
    ids = ids.select(key)
    if ids.count() * 48 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return docs.join(ids, key, "left_semi").select(*docs.columns)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
