"""What the operators share: the shared folder, tables written to cut lineage, and code shipped to executors."""

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.shipping import ship_package

#: Temporary folders of local sessions that name no shared one.
_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestream-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodestream/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again, so that a lost executor costs no recomputation. A small
    table is written in a sixteenth of the usual number of files."""
    spark = df.sparkSession
    (df.coalesce(max(1, partitions(spark) // 16)) if small else df).write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what ``written`` has left in the shared folder. No result that still reads it may be in use."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/lodestream")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks for the steps that read it again. What a lost executor held is computed
    anew from its lineage, which is a few steps here; later steps and loops cut theirs with ``written``."""
    return df.persist(StorageLevel.DISK_ONLY)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, however the driver found it; and keep Arrow batches small,
    since one row can be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship_package(spark)


def text_of(column: str = "text"):
    """The column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
