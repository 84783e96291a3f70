"""A table that is replaced as a whole and can be read at any moment.

Every version has a folder of its own under ``data``. It counts from the moment an empty file with its number and name
is in ``_commits``; creating that file is one step of the file system. Readers take the version committed last, so
they see all of the old one or all of the new one, also while a writer is at work or after it was stopped.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lingospan.sources.readers import _file_system

COMMITS, DATA = "_commits", "data"
_COMMIT = re.compile(r"(\d{12})_([A-Za-z0-9-]+)")


def committed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the committed versions that are still there, the oldest first."""
    files, folder = _file_system(spark, f"{path}/{COMMITS}")
    if not files.exists(folder):
        return []
    found = (_COMMIT.fullmatch(status.getPath().getName()) for status in files.listStatus(folder))
    return sorted((int(m[1]), m[2]) for m in found if m)


def commit(spark: SparkSession, path: str, number: int, version: str) -> None:
    """Make a written version the one that readers take."""
    files, target = _file_system(spark, f"{path}/{COMMITS}/{number:012d}_{version}")
    files.create(target, False).close()


def publish(df: DataFrame, path: str, version: str, keep: int = 2) -> bool:
    """Write ``df`` as ``version`` of the table at ``path`` and commit it; False if it is committed already.

    What a stopped attempt left of this version was never visible and is written anew. The newest ``keep`` versions
    before this one stay for readers that are still at them; older ones are removed. One writer at a time.
    """
    if not re.fullmatch(r"[A-Za-z0-9-]+", version):
        raise ValueError(f"a version is named by letters, digits and hyphens, got {version!r}")
    if keep < 0:
        raise ValueError("keep is 0 or more")
    spark = df.sparkSession
    done = committed(spark, path)
    if any(name == version for _, name in done):
        return False
    df.write.mode("overwrite").parquet(f"{path}/{DATA}/{version}")
    commit(spark, path, done[-1][0] + 1 if done else 0, version)
    for number, old in done[: len(done) - keep]:
        # No longer offered before it is gone.
        for gone in (f"{COMMITS}/{number:012d}_{old}", f"{DATA}/{old}"):
            files, target = _file_system(spark, f"{path}/{gone}")
            files.delete(target, True)
    return True


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The version committed last; ``FileNotFoundError`` before the first."""
    done = committed(spark, path)
    if not done:
        raise FileNotFoundError(f"no version of {path} is committed")
    return spark.read.parquet(f"{path}/{DATA}/{done[-1][1]}")
