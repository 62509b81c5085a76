"""Folders that are replaced as a whole, on any store.

Data lies in folders of its own below the path, and a log of numbered entries names one of them each. An entry is created,
never changed or renamed, and the highest whole one is what counts. So a writer that dies leaves the old data in place at
every step before its entry is whole, and the new data at every step after; two writers get two numbers. The version before
the last stays for readers that are under way, older ones go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_log"


def _store(spark: SparkSession, path: str):  # noqa: ANN202  a Hadoop file system, and its paths
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _entries(spark: SparkSession, path: str) -> list[tuple[int, str | None]]:
    """Number and folder of the entries of the log; the folder of one that is not whole is None."""
    files, place = _store(spark, path)
    log = place(f"{path}/{LOG}")
    if not files.exists(log):
        return []
    found = []
    for status in files.listStatus(log):
        name = status.getPath().getName()
        if name.isdigit():
            stream = files.open(status.getPath())
            try:
                said = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found.append((int(name), said.strip() if said.endswith("\n") else None))
    return sorted(found)


def current(spark: SparkSession, path: str) -> str:
    """Where the data of path is: the last version, or path itself if it was never replaced."""
    path = path.rstrip("/")
    whole = [folder for _, folder in _entries(spark, path) if folder]
    return f"{path}/{whole[-1]}" if whole else path


def replace(df: DataFrame, path: str, kind: str = "json") -> str:
    """Write df as the next version of path; returns where it is."""
    spark, path = df.sparkSession, path.rstrip("/")
    folder = f"data-{uuid.uuid4().hex}"
    writer = df.write.option("ignoreNullFields", "false") if kind == "json" else df.write
    writer.format(kind).save(f"{path}/{folder}")
    commit(spark, path, folder)
    clean(spark, path)
    return f"{path}/{folder}"


def commit(spark: SparkSession, path: str, folder: str) -> int:
    """Add the entry that makes a folder the last version; of writers that want one number the second takes the next."""
    files, place = _store(spark, path)
    number = max((n for n, _ in _entries(spark, path)), default=0) + 1
    while True:
        at = place(f"{path}/{LOG}/{number:012}")
        try:
            stream = files.create(at, False)
        except Exception:  # noqa: BLE001  another writer has it, or the store cannot be written
            if not files.exists(at):
                raise
            number += 1
            continue
        stream.write(bytearray(f"{folder}\n".encode()))
        stream.close()
        return number


def clean(spark: SparkSession, path: str) -> None:
    """Delete the versions before the last two, data first, and with the second version what lay at path before the first."""
    files, place = _store(spark, path)
    entries = _entries(spark, path)
    whole = [e for e in entries if e[1]]
    if len(whole) < 2:
        return
    for number, folder in entries:
        if number < whole[-2][0]:
            if folder:
                files.delete(place(f"{path}/{folder}"), True)
            files.delete(place(f"{path}/{LOG}/{number:012}"), False)
    for status in files.listStatus(place(path)):
        name = status.getPath().getName()
        if name != LOG and not name.startswith("data-"):
            files.delete(status.getPath(), True)
