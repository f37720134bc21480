"""What every operator that runs Python on the executors needs from the session."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

import myospark

#: Rows of one Arrow batch: texts can be long, and a batch is held in memory whole.
BATCH_ROWS = 1024


def ensure_workers(spark: SparkSession) -> SparkSession:
    """Make this package usable in Python workers, wherever the driver was started.

    Functions of the package travel by value with the tasks, so executors need no copy of it.
    Arrow batches are kept small.
    """
    if myospark.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(myospark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def kept(name: str, make: Callable[[], object]) -> object:
    """In a Python worker: what `make` made for an earlier task. Functions travel by value with each task, so it is kept in a module that stays."""
    found = vars(sys).setdefault("_myospark_kept", {})
    if name not in found:
        found.clear()
        found[name] = make()
    return found[name]


def give_back(but: str | None = None) -> None:
    """In a Python worker, before a task: return memory that earlier tasks have freed to the system, which allocators otherwise keep for later.

    What was kept from task to task goes too, but for the one named.
    """
    found = vars(sys).get("_myospark_kept", {})
    for name in [n for n in found if n != but]:
        del found[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc's
        ctypes.CDLL(None).malloc_trim(0)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names. Only a local session may do without a name: it gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def release(spark: SparkSession) -> None:
    """On the driver, before a table is written: collect what earlier steps left, in Python and then in the JVM.

    Spark removes shuffle files and broadcasts when the driver's JVM has collected the plans that they belong to. Of itself it does
    that when its heap is full, and the heap then stays large. Python tells the JVM of what it has collected within a second, so some of it goes
    with the next table. What the JVM has freed outside its heap is returned to the system.
    """
    give_back()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """On the driver: have the JVM return freed native memory to the system, which its allocator otherwise keeps; what the JVM says of it.

    It is left by compiled plans and network buffers. The command is `jcmd System.trim_native_heap`; a JVM without it does nothing.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind: object, *values: object) -> object:
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    with suppress(Py4JError, PySparkException):
        lang = jvm.java.lang
        types = [lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *types))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return str(invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, commands, "systemTrimNativeHeap", array(lang.Object), array(lang.String))))
    return ""


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that later reads survive lost executors."""
    ensure_checkpoints(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


@contextmanager
def batch_rows(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Arrow batches of this many rows for the actions inside: for short rows of which there are many.

    size: bytes of a batch, about, where some of the actions' rows hold texts.
    """
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    was = {k: spark.conf.get(k) for k, v in keys.items() if v is not None}
    for k in was:
        spark.conf.set(k, str(keys[k]))
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
