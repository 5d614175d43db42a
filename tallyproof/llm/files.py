"""Files of other formats than Spark's, written and read by tasks in the shared folder.

A task writes a file under a name that no other attempt has and reports it in a row. The rows are kept
in a written table, so only files of attempts that succeeded are ever read, and a lost executor costs no
more than its unfinished files. Names of Hadoop file systems are opened with Arrow's own.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from tallyproof.session import _hadoop, scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, as a URI that tasks can open; deleted when the application
    ends."""
    at, files = _hadoop(spark, scratch_path(spark, name))
    files.mkdirs(at)
    return files.makeQualified(at).toString()


def qualified(spark: SparkSession, path: str) -> str:
    at, files = _hadoop(spark, path)
    files.mkdirs(at)
    return files.makeQualified(at).toString()


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", uri)
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri)


def own_name(folder: str, kind: str) -> str:
    """A file name for this attempt of this task."""
    context = TaskContext.get()
    number = context.partitionId() if context else 0
    return f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.{kind}"


def open_to_write(uri: str):
    system, path = _place(uri)
    return system.open_output_stream(path, compression=None)  # formats compress by themselves


def open_to_read(uri: str):
    """A file that can be read from any place."""
    system, path = _place(uri)
    return system.open_input_file(path)
