"""What the package needs of a session: its modules on executors, and the folder that all share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A temporary folder of this machine stands in only where the setting is unset and the session is local; on a cluster
    without the setting this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_root, "own", None)
    if own is None:
        own = shared_root.own = tempfile.mkdtemp(prefix="colform-")
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written once into the shared folder as Parquet, so that what is computed of them never sees other ones.

    Later steps read only the columns they need, and a lost executor costs a reread.
    """
    path = f"{shared_root(df.sparkSession)}/colform-rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Sends the package to Python workers once a session, through Spark's own file server.

    Needed where workers do not inherit the driver's import path; harmless where they do.
    """
    context = spark.sparkContext
    if getattr(context, "_colform_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="colform-ship-")) / "colform.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"colform/{source.relative_to(root)}")
    context.addPyFile(str(target))
    context._colform_shipped = True
