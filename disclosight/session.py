"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder for sessions that name none, if a caller has decided on one.
_chosen: dict[str, str] = {}


def build_session(app: str = "disclosight", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster the submit command names the master; ``master`` is for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def named_folder(spark: SparkSession) -> str | None:
    """What the session itself names as its shared folder."""
    return spark.conf.get("spark.checkpoint.dir", None)


def use_folder(path: str) -> None:
    """Decide on a folder for sessions that name none, as tests and local runs do."""
    _chosen["path"] = path


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the one decided on."""
    folder = named_folder(spark) or _chosen.get("path")
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def working_table(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame below the shared folder and read it back, so that it is worked out once."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
