"""Session helpers: settings the library relies on, shared storage, and code shipping."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that the SQL semantics of the library rely on, and the state store that typed state needs.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster bring your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cuetide")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SQL_SETTINGS to a session made elsewhere and make the package importable on executors."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python functions can import it there."""
    context = spark.sparkContext
    if getattr(context, "_cuetide_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cuetide-ship-")) / "cuetide_pkg.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = Path(folder) / name
                    archive.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(target))
    context._cuetide_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, local sessions get one of their own and clusters an error. On
    a cluster a file: folder must be one that all machines mount; that cannot be seen from here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="cuetide-shared-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuetide/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cuetide_path = path
    _KEPT.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return found


#: Folders that each application has stored and not let go.
_KEPT: dict[str, set[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _KEPT.get(spark.sparkContext.applicationId, set()).discard(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def let_go(*tables: DataFrame) -> None:
    """Delete what stored() wrote for these tables. Nothing that was made from them and not stored can be read after."""
    for table in tables:
        if path := getattr(table, "_cuetide_path", None):
            _delete(table.sparkSession, path)


def keep_folder(spark: SparkSession, path: str) -> str:
    """Note a folder written otherwise, so that temporary_tables() and clear() know of it."""
    _KEPT.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Within this scope results are computed and written or collected; what was stored for them is deleted at its end."""
    before = set(_KEPT.get(spark.sparkContext.applicationId, ()))
    try:
        yield
    finally:
        for path in sorted(_KEPT.get(spark.sparkContext.applicationId, set()) - before):
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored."""
    for path in sorted(_KEPT.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)
