"""Session defaults."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "linkloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def register_views(**frames: DataFrame) -> None:
    """discoveries, canonical, candidates, verified, dead and so on, for SQL."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


_stored: list[tuple[SparkSession, str]] = []


def stored_path(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder (spark.checkpoint.dir), deleted in the end. In one process without that
    setting, the folder is a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/linkloom-base/{uuid.uuid4().hex}-{name}"
    _stored.append((spark, path))
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once to the shared folder and read again: lineage is cut, and whatever made it (requests, say) is not done anew."""
    path = stored_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def forget() -> None:
    """Delete the paths of stored_path(); frames of them can't be read any more."""
    while _stored:
        spark, path = _stored.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended already
            return
