"""Session, table and working-folder helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "blocks windows facts evidence relations canon_terms source_info mix_targets").split()


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """Session for one machine; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("ledgerloom")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
            # checkpoints go when nothing refers to them any more; a cluster sets the same
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Their Python workers need it for Arrow functions; the driver's own path
    settings do not reach them.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ledgerloom-code-")  # Spark serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/ledgerloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(f"{folder}/ledgerloom.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder a cluster names in spark.checkpoint.dir holds cut lineage.

    A temporary folder is used only where the setting is absent and the master
    is local, that is in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix=f"ledgerloom-{os.getpid()}-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written in the shared checkpoint folder, for loops.

    A checkpoint keeps the size estimate of its plan, and in a loop of joins
    the estimates multiply until they fill the driver; a written table is
    estimated by its files.
    """

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables; nothing that reads them may be used afterwards."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
