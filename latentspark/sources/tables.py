"""Table readers and lineage cuts in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text with a header; an unnamed first column becomes ``_c0``.

    Pass a schema for large inputs: without one Spark reads the file twice to infer types.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def sentinel_to_null(df: DataFrame, sentinel: float = -99, columns: Iterable[str] | None = None) -> DataFrame:
    """Numeric columns with the sentinel (and NaN) read as NULL; other columns stay as they are."""
    wanted = set(df.columns if columns is None else columns)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in wanted and isinstance(f.dataType, T.NumericType):
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = F.nanvl(c, F.lit(None).cast(f.dataType))
            c = F.nullif(c, F.lit(sentinel).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one on this machine,
    which only a local master may use: the executors of a cluster would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="latentspark-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lineage cut that survives
    the loss of executors. The files are removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/latentspark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
