"""Written intermediate tables in the folder that driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``; only where that is unset and
driver and executors are one process (master local, as in tests) a temporary folder is
made and set as checkpoint folder.  On a cluster an unset folder is an error.
A written table cuts lineage and outlives lost executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where the shared folder is a mounted one: no file of checksums beside each part, as Parquet has its own, and each new
#: file costs the executor a process that sets its permissions.
RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with signs added where df has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def base(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="veilcount-")
        context.setCheckpointDir(named)
        atexit.register(_remove, spark, named)
        return named
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone, and with it the means to delete
        pass


class Scratch:
    """Tables of one operator call. ``put`` writes and rereads, ``drop`` removes one that nothing reads any more.

    Tables that the returned DataFrame reads stay until the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{base(spark).rstrip('/')}/veilcount-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_remove, spark, self.root)
        # Exchanges of a step that is written to a table are of no use once it is written; batches that Python
        # works on are small, as it cuts them into blocks of about this many rows anyway.
        self.settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            conf.set(k, v)
        try:
            df.write.options(**RAW).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v) if v is not None else conf.unset(k)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, t._scratch_path)
