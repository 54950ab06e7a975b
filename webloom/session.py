"""Sessions, and the one place where intermediate results are written.

Iterative operators cut their lineage here. Intermediates go to the folder
named by ``spark.checkpoint.dir``, which every executor can read, so losing an
executor never loses an intermediate. Only a local session without that
setting falls back to a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def local_session(name: str = "webloom", cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="webloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "webloom_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediates: ``spark.checkpoint.dir`` of the session.

    Raises if it is unset on a cluster: a machine-local folder would not be
    readable by the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


class Scratch:
    """Written intermediates of one operator call.

    ``keep`` writes a DataFrame as Parquet into the shared folder and returns
    the table read back; ``drop`` deletes tables no longer read. Tables that the
    returned lazy result still reads stay until the session ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._quiet_drop_all)

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.mode("error").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._webloom_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_webloom_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _quiet_drop_all(self) -> None:
        try:
            if self.spark._jsc is not None and self.spark._jvm is not None:
                self._delete(self.root)
        except Exception:  # the session is gone; the folder's owner cleans up
            pass
