"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

SETTINGS = {
    # One time zone, so time stamps without a zone never shift.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffles start with the configured number of partitions and are merged to this size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # 168 lag columns plus their inputs have to stay inside generated code.
    "spark.sql.codegen.maxFields": "400",
    # Java does not compile longer methods; a stage that would have one takes the projections that are split.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "heliopanel", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the engine's settings; `conf` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of driver values, handed over as one Arrow table."""
    fields = StructType.fromDDL(schema)
    names = fields.fieldNames()
    types = [to_arrow_type(f.dataType) for f in fields]
    columns = [pa.array([row[i] for row in rows], type=t) for i, t in enumerate(types)]
    return spark.createDataFrame(pa.table(columns, names=names), fields)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for data this session writes and reads again, below `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/heliopanel-{uuid.uuid4()}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="heliopanel-") + "/data"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives lost executors.

    The folder is the one the cluster names in `spark.checkpoint.dir`. Only a local
    session without that setting gets a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or shared_folder(df.sparkSession))
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that `shared_folder` has named, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
