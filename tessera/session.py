"""Session settings that the operators are written for, and the folder that all machines share."""

import re
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "tessera", **settings: str) -> SparkSession:
    """The running session or a new one, with SETTINGS and then `settings` (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    return builder.config(map={k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a run on one machine gets a temporary folder, which
    the session remembers; on a cluster that is an error, as its machines would each see a folder of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[[^,]|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def together(spark: SparkSession, *steps: Callable) -> list:
    """Runs steps that write tables of their own at the same time, one thread each, with the caller's job properties;
    gives their results."""
    shared_folder(spark)  # told before the threads ask for it
    told = inheritable_thread_target(spark)  # without pinned threads this is the session itself
    with ThreadPoolExecutor(len(steps)) as pool:
        return [x.result() for x in [pool.submit(told(f) if callable(told) else f) for f in steps]]
