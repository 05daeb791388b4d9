"""Files: which parser takes a path, whole-file reading, file types of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name


def parser_for(path: Column) -> Column:
    """config, java, jsp or null; the configuration parser has priority."""
    name = F.lower(file_name(path))
    config = name.isin("web.xml", "struts-config.xml", "tiles-defs.xml") | (name.contains("struts") & name.endswith(".xml"))
    return F.when(config, "config").when(path.endswith(".java"), "java").when(name.rlike(r"\.jspx?\z"), "jsp")


def file_type(path: Column) -> Column:
    """Type of a changed file by its extension. Only a path with a folder has a file name here, so that a web.xml at the
    root is plain XML."""
    low = F.lower(path)
    name = F.when(path.contains("/"), file_name(path)).otherwise("")
    config = name.isin("web.xml", "struts-config.xml", "tiles-defs.xml") | name.contains("struts")
    return (
        F.when(low.endswith(".java"), "JAVA").when(low.rlike(r"\.jspx?\z"), "JSP").when(low.endswith(".xml"), F.when(config, "CONFIG").otherwise("XML"))
        .when(low.endswith(".properties"), "PROPERTIES").when(low.endswith(".sql"), "SQL").when(low.endswith(".js"), "JAVASCRIPT").when(low.endswith(".css"), "CSS").otherwise("OTHER")
    )


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of every file below root, whole."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_diffs(spark: SparkSession, root: str) -> DataFrame:
    """(diff_id, raw_diff): a file of a unified diff, or all files below a folder; a diff's id is its path."""
    return read_files(spark, root).select(F.col("path").alias("diff_id"), F.col("text").alias("raw_diff"))
