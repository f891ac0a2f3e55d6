"""Settings of a session that the operators ask for."""

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folders that were made for intermediate tables, until they are discarded.
_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared one of spark.checkpoint.dir. Only where that is unset and the
    session is local, as in tests, is a temporary folder of this machine made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


#: Setting by which Spark drops the shuffle files of a query when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """df as a table written to the shared folder and read back: lineage ends here, and the
    loss of an executor costs only the reading task. The shuffle files behind it are not wanted
    any more and are dropped."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path := path or scratch(spark), partitionBy=partition_by)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Lets go of plans of finished jobs and of what only they refer to, and hands memory that is free
    back to the machine. In a loop of many jobs the driver's heap would else grow to its limit and
    stay there, however little is in use; and so would what its compilers work in, outside the heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Hands free memory outside the driver's heap back to the machine, as malloc_trim does; False
    where the JVM has no such command."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    try:
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")


def exists(spark: SparkSession, path: str) -> bool:
    files, where, _ = _file_system(spark, path)
    return files.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    files, where, _ = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, once no result that reads it is wanted."""
    files, where, _ = _file_system(spark, path)
    files.delete(where, True)


def discard(spark: SparkSession) -> None:
    """Deletes the intermediate tables made so far, once no result that reads them is wanted."""
    while _made:
        remove(spark, _made.pop())


def stage(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; build() is run and written there unless an earlier run has finished it."""
    files, _, done = _file_system(spark, path)
    if not files.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
