"""Tables written on the way, in the folder that all nodes share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written on the way: the one the context has, else the one that spark.checkpoint.dir names.

    Without either, a session of this one machine (tests) gets a temporary one; on a cluster, where such a folder
    is another one on each node, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="citeframe-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; where spark.cleaner.referenceTracking.cleanCheckpoints is on, Spark removes it once unused."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that was written on the way."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Keys of more rows than this part of all are few enough to be broadcast.
HOT = 1000


def frequent(counts: DataFrame, key: list[str], rows: int) -> DataFrame:
    """Of counts (key, c) of a table of so many rows, the keys of more than one HOT-th of them; as there are fewer than HOT, they come to the driver."""
    often = counts.filter(F.col("c") > rows / HOT).select(*key)
    return counts.sparkSession.createDataFrame(often.collect(), often.schema)


def hot_join(left: DataFrame, right: DataFrame, key: list[str], often: DataFrame) -> DataFrame:
    """left join to a table with distinct keys, where no task gets all rows of a frequent key: `often`, as frequent() has them, are broadcast, the others shuffled."""
    hot = F.broadcast(often.join(right, key, "left"))
    rest = left.join(F.broadcast(often), key, "left_anti").join(right, key, "left")
    return left.join(hot, key).unionByName(rest)
