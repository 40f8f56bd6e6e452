"""Session and lineage helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle parallelism, used where an operator needs an explicit partition number."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def plain_unions(spark: SparkSession) -> None:
    """Keep Spark from taking a union of frames with equal partitioning as partitioned that way itself. Adaptive
    execution merges the partitions of each of them differently, so grouping such a union without a shuffle, as Spark
    4.1 then does, gives a key several groups."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables that a query writes for itself.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where none is set and the master is this machine
    (tests) a temporary one is made; elsewhere a machine-local folder would lose data with its machine, so that is an
    error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master or "").startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder. Files go away with the frame when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def local_session(name: str = "tessera", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plain_unions(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Set what the queries rely on, and send the package to the Python workers where they would not find it by themselves (neither installed on the
    path they inherit nor in the working folder)."""
    import os
    import zipfile

    plain_unions(spark)
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.abspath(os.getcwd()) == root or getattr(spark.sparkContext, "_tessera_sent", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._tessera_sent = True
