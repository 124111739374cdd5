"""Whether input is there, on the file system the session reads it from."""

from __future__ import annotations

from pyspark.sql import SparkSession


def present(spark: SparkSession, path: str) -> bool:
    """True if ``path`` names a file or folder, or, as a pattern, at least one.

    The path is resolved as Spark's readers do: by its scheme, else on the session's default file system. A file whose
    plain name looks like a pattern counts as itself. So a plain path that is absent and a pattern that matches nothing
    both are empty input; anything that exists is read, and an error in it is raised.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(hadoop)
    return bool(found) or files.exists(hadoop)
