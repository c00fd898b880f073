"""Session helpers shared by every layer: table access, lineage cutting, defaults.

Nothing here reads data eagerly; ``cut_lineage`` is the only action and it writes to the shared checkpoint folder.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "docmill") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_docmill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # not itself inside an archive that was shipped already
        folder = tempfile.mkdtemp(prefix="docmill-py-")  # only read by the driver's file server
        copy = Path(folder, "code", package.name)
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(Path(folder, package.name)), "zip", copy.parent))
    context._docmill_shipped = True


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def checkpoint_base(spark: SparkSession) -> str:
    """The folder all executors share: the context's, else the session's ``spark.checkpoint.dir``. Only on one machine, as
    in tests, a temporary folder takes its place; a cluster that names none is an error."""
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        named = tempfile.mkdtemp(prefix="docmill-ck-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared one."""
    return f"{checkpoint_base(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder all executors share."""
    checkpoint_base(df.sparkSession)
    return df.checkpoint(eager=True)
