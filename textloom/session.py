"""Session helpers that every part of the library shares."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "textloom", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers on other machines import it by name, so caches held in its modules outlive a task.
    """
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    sc._textloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or on one machine a folder of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # a setting of Spark's core can't be changed in a running session
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not getattr(sc, "_textloom_folder", None):
            sc._textloom_folder = "file://" + tempfile.mkdtemp(prefix="textloom-shared-")
        base = sc._textloom_folder
    return base.rstrip("/")


class Workspace:
    """Intermediate tables in the shared folder; they cut lineage and survive the loss of an executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"
        atexit.register(self.remove, "")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, release: bool = True) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        del df
        if release:
            self.release()
        return self.load(name, schema)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps, which it does once nothing refers to them.

        save() does so for the steps before it; its own frame is still referred to by its caller.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(name))

    def remove(self, name: str) -> None:
        """Delete one table, or with an empty name all of them."""
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the application may have ended
            pass
