"""What a Spark session needs to run this package's Python functions on executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        root = Path(tempfile.mkdtemp(prefix="spark-"))
        shutil.copytree(here, root / "src" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(root / here.name), "zip", root / "src"))
        _shipped.add(app)


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below the session's checkpoint folder, or in local mode one of this machine where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base}/scratch-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="spark-")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to a scratch folder and read again: for a dear plan that several branches read."""
    path = scratch(df.sparkSession)
    df.write.parquet(f"{path}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
