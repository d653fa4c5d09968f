"""Folders of files: listed, compared, and cleared once nobody uses them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import chunk_number, shared

#: Where folders on their way out wait; listings pass over names that begin with a dot.
LEAVING = ".leaving"


def _store(spark: SparkSession, root: str):
    """File system of a folder, the folder's whole name, and what makes a path in it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    path = make(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path).toString().rstrip("/"), make


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All files under a folder, at any depth: folder (first part of the path, null for files of the root), name, path, length, modified.

    Spark lists folders side by side; contents are not read. Names that begin with
    a dot or an underscore are passed over, as in any read, and so are files without
    a byte: a folder with no others isn't seen here. A root that is empty
    or holds no files: no rows; one that is not there: an error.
    """
    fs, whole, make = _store(spark, root)
    if not fs.exists(make(root)):
        raise FileNotFoundError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(whole).select("path", "length", F.col("modificationTime").alias("modified"), F.col("_metadata.file_name").alias("name"))
    # the path is a plain name or an address, so the root is looked for by its part behind the scheme
    inside = F.substring_index("path", make(whole).toUri().getPath() + "/", -1)
    return files.select(F.when(F.contains(inside, F.lit("/")), F.substring_index(inside, "/", 1)).alias("folder"), "name", "path", "length", "modified")


def folder_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes of each folder of a listing."""
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def chunk_files(files: DataFrame) -> DataFrame:
    """Files of a listing that are chunks by their name, with the chunk's number; others are passed over."""
    return files.withColumn("chunk", chunk_number(F.col("name"))).where("chunk is not null")


def created(before: DataFrame, after: DataFrame) -> DataFrame:
    """Folders of the second listing that the first does not have."""
    return after.select("folder").distinct().join(before.select("folder"), "folder", "left_anti").where("folder is not null")


def clear(spark: SparkSession, root: str, in_use: Callable[[], DataFrame]) -> DataFrame:
    """Delete folders under a root that are not in use: folder, files, bytes, state.

    ``in_use`` returns the folders in use (column folder) as they are when it is
    called, which is twice. First folders that are not in use are moved aside,
    which is one step for each, so that whoever opens one afterwards makes a new
    one. Then, those that came into use meanwhile are moved back ("kept") unless a
    new one has their name, and all others deleted ("deleted", or "replaced" where
    a new one has come). Files of the root itself stay. A clearing that was broken
    off leaves folders aside: the next one deletes them (``sweep``). Sizes are
    those of the first listing; names go to the driver one at a time.
    """
    fs, whole, make = _store(spark, root)
    notes, aside = shared(spark, "clearing"), f"{whole}/{LEAVING}/{uuid.uuid4().hex}"
    used = lambda: in_use().select("folder").where("folder is not null").distinct()
    folder_sizes(listing(spark, root)).where("folder is not null").join(used(), "folder", "left_anti").write.parquet(f"{notes}/found")
    found = spark.read.parquet(f"{notes}/found")
    fs.mkdirs(make(aside))
    for row in found.select("folder").toLocalIterator():
        fs.rename(make(f"{whole}/{row.folder}"), make(f"{aside}/{row.folder}"))
    found.join(used().withColumn("_again", F.lit(True)), "folder", "left").withColumn("_again", F.col("_again").isNotNull()).write.parquet(f"{notes}/second")
    second = spark.read.parquet(f"{notes}/second")

    def settle(folder: str, again: bool) -> str:
        at, home = make(f"{aside}/{folder}"), make(f"{whole}/{folder}")
        if not fs.exists(at):
            return "missing"
        taken = fs.exists(home)
        if again and not taken and fs.rename(at, home):
            return "kept"
        fs.delete(at, True)
        return "replaced" if taken else "deleted"

    states = ([row.folder, settle(row.folder, row._again)] for row in second.select("folder", "_again").toLocalIterator())
    rows = _told(spark, states, f"{notes}/states")
    fs.delete(make(aside), True)
    return second.drop("_again").join(rows, "folder").select("folder", "files", "bytes", "state")


def _told(spark: SparkSession, states, path: str, at_once: int = 10_000) -> DataFrame:
    """States as a table, written a bounded number at a time."""
    schema, held = "folder string, state string", []

    def put() -> None:
        spark.createDataFrame(held, schema).coalesce(1).write.mode("append").parquet(path)

    for state in states:
        held.append(state)
        if len(held) == at_once:
            put()
            held = []
    put()
    return spark.read.schema(schema).parquet(path)


def sweep(spark: SparkSession, root: str) -> bool:
    """Delete what clearings that were broken off have moved aside; no clearing may run meanwhile."""
    fs, whole, make = _store(spark, root)
    return fs.delete(make(f"{whole}/{LEAVING}"), True)
