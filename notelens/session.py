"""Session defaults and the shared folder for written stage tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Settings the plans in this package are written for.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: Folders of local sessions that name none.
_LOCAL_FOLDERS: dict[str, str] = {}


#: Folders of open scopes.
_SCOPES: dict[str, str] = {}


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[str]:
    """Stage tables written inside go to a folder of their own, which is removed at the end.

    Results must be written or collected inside: what is read lazily from a stage table is gone afterwards. Scopes may be
    nested; the inner one's tables go first.
    """
    application = spark.sparkContext.applicationId
    outer = _SCOPES.get(application)
    folder = f"{stage_dir(spark)}/scope-{uuid.uuid4().hex}"
    _SCOPES[application] = folder
    try:
        yield folder
    finally:
        if outer is None:
            del _SCOPES[application]
        else:
            _SCOPES[application] = outer
        for table in spark.catalog.listTables():
            if not table.isTemporary and folder in str(spark.sql(f"DESCRIBE TABLE EXTENDED `{table.name}`").where("col_name = 'Location'").first()):
                spark.sql(f"DROP TABLE `{table.name}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def build_session(app: str = "notelens", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_dir(spark: SparkSession) -> str:
    """Folder for stage tables: ``spark.checkpoint.dir``, as the cluster names it.

    Only a local session may do without that setting; it then gets a temporary
    folder. A cluster session without it is refused, because a machine-local
    folder is not readable from the other executors.
    """
    if spark.sparkContext.applicationId in _SCOPES:
        return _SCOPES[spark.sparkContext.applicationId]
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can read")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="notelens-stage-")
    return _LOCAL_FOLDERS[application]
