"""Tables kept in the shared folder: cut lineage, and what is derived from a corpus once for all queries."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


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


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: another one once the table was written again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return hashlib.sha256("|".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in listed)).encode()).hexdigest()[:24]


#: Tables written by this application, by name and by what they were made of.
_kept: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def keep(spark: SparkSession, key: str, name: str, make: Callable[[], DataFrame], order: str) -> DataFrame:
    """A table derived from what key tells of, made on first use and read afterwards.

    It is ranged and sorted by the column `order`, so a scan for one of its values reads few row groups."""
    place = (spark.sparkContext.applicationId, key, name)
    if place not in _kept:
        path = f"{shared_dir(spark)}/textquarry/{place[0]}/{key}/{name}"
        df = make()
        df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)
        _kept[place] = (path, df.schema)
    path, schema = _kept[place]
    return spark.read.schema(schema).parquet(path)
