"""Session and shared-folder helpers."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores="*", shuffle_partitions=8, **conf):
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("newsmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("NEWSMILL_DRIVER_MEMORY", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark):
    """Folder every executor can reach: the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session may fall back to a
    machine-local folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    conf = conf or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="newsmill-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def run_dir(spark, label):
    """A fresh folder below the shared one, for one run's tables."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_shipped = set()


def ship_package(spark):
    """Make this package importable in Python workers, once per application.

    The archive goes to every executor the way ``--py-files`` does.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="newsmill-package-"), "newsmill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
