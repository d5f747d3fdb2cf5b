"""Sources and sinks: files, pandas, synthetic cells, and tables that are written once."""

from __future__ import annotations

import platform
import tempfile
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.domain import Domain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema: nothing is inferred from the data."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def from_pandas(spark: SparkSession, frame, columns: list[str]) -> DataFrame:
    return spark.createDataFrame(frame[columns])


def from_vector(spark: SparkSession, domain: Domain, vector) -> DataFrame:
    """A dense row-major data vector as cells (columns of the domain, n); zero cells are left out."""
    import numpy as np

    x = np.asarray(vector, float).reshape(domain.sizes)
    at = np.argwhere(x != 0)
    rows = [(*map(int, a), float(x[tuple(a)])) for a in at]
    return spark.createDataFrame(rows, ", ".join([*(f"`{n}` int" for n in domain.names), "n double"]))


def synthetic_cells(spark: SparkSession, domain: Domain, seed: int = 42) -> DataFrame:
    """Every cell of the domain with a count of 1 .. 49 from a hash of cell and seed."""
    full = (1 << len(domain)) - 1
    cells = spark.range(domain.size(full))
    coords = [F.pmod(F.floor(F.col("id") / s), F.lit(domain.sizes[i])).cast("int").alias(domain.names[i]) for i, s in domain.strides(full).items()]
    return cells.select(*coords[::-1], (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(49)) + 1).alias("n"))


def synthetic_rows(spark: SparkSession, domain: Domain, seed: int = 42) -> DataFrame:
    return synthetic_cells(spark, domain, seed).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("copy", "n")


def zeros(spark: SparkSession, domain: Domain, rows: int = 10_000) -> DataFrame:
    return spark.range(rows).select(*(F.lit(0).alias(n) for n in domain.names))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.gettempdir()


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_once(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder, or to path unless it is there already, and reread, so that it is computed once.

    A noisy column that Spark computed twice would spend the privacy budget twice.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/veilcount-{name}-{uuid.uuid4().hex}"
    if not written(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hardware() -> dict[str, str]:
    return {"spark": pyspark.__version__, "python": platform.python_version(), "system": platform.platform(), "machine": platform.machine()}
