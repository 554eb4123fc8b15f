"""Where intermediate tables go: the folder that the cluster shares and names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that the session names; only where it is unset, on one machine (local[..], as in tests), a temporary
    one that is deleted at the end."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lattica-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder below the shared one that nothing else uses."""
    base = shared_base(spark)
    uri = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}".rstrip("/") + f"/{name}-{uuid.uuid4().hex}"
    _written.append(uri)
    return uri


def saved(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: cuts the lineage and outlives lost executors."""
    uri = new_folder(df.sparkSession, "table")
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def clean() -> int:
    """Deletes all that this process has written to the shared folder, once nothing reads it any more: results that
    still stand on such tables are lost. How many folders there were."""
    from pyarrow import fs

    n = 0
    while _written:
        where, path = fs.FileSystem.from_uri(_written.pop().replace("s3a://", "s3://", 1))
        if where.get_file_info(path).type == fs.FileType.Directory:
            where.delete_dir(path)
            n += 1
    return n
