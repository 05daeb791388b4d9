"""Unified diffs as tables: commits in, file changes, hunks and lines out. No user code: running sums number the files and
hunks of each diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines
from ..sources.files import file_type

# The formats of commit addresses and of diff lines.
URL = r"^https?://([^/]+)/(.+?)/(.+?)/commit/([a-f0-9]+)(?:/diff/(.+))?$"
FILE = r"^diff --git a/(.+) b/(.+)$"
HUNK = r"^@@\s+-([0-9]+)(?:,([0-9]+))?\s+\+([0-9]+)(?:,([0-9]+))?\s+@@(.*)$"
BINARY = r"^Binary files .+ differ$"


def parse_url(url: Column) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(url, URL, i), F.lit(""))
    return F.struct(part(1).alias("host"), part(2).alias("workspace"), part(3).alias("repository"), part(4).alias("commit"), part(5).alias("file"), F.when(~url.rlike(URL), "not a commit address").alias("error"))


def parse_commit(json: Column) -> Column:
    """message, author, date (texts, empty if missing) and parents."""
    at = lambda p: F.coalesce(F.get_json_object(json, p), F.lit(""))
    parents = F.coalesce(F.from_json(F.get_json_object(json, "$.parents"), "array<struct<hash: string>>"), F.array().cast("array<struct<hash: string>>"))
    return F.struct(at("$.hash").alias("hash"), at("$.message").alias("message"), at("$.author.user.display_name").alias("author"), at("$.date").alias("date"), F.transform(parents, lambda p: F.coalesce(p["hash"], F.lit(""))).alias("parents"))


def _numbered(diffs: DataFrame) -> DataFrame:
    """One row a line: diff_id, pos, text, what it is, and the numbers of its file and hunk."""
    rows = diffs.select("diff_id", F.posexplode(lines(F.col("raw_diff"))).alias("pos", "text"))
    t = F.col("text")
    kind = F.when(t.rlike(FILE), "file").when(t.rlike(BINARY), "binary").when(t.rlike(HUNK), "hunk").otherwise("line")
    order = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", kind).withColumn("file_no", F.sum((F.col("kind") == "file").cast("int")).over(order).cast("int"))
    within = Window.partitionBy("diff_id", "file_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("hunk_no", F.sum((F.col("kind") == "hunk").cast("int")).over(within).cast("int"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_no, hunk_no, pos, kind, text) of the lines within hunks: added, deleted or context; the mark is taken
    off added and deleted lines."""
    rows = _numbered(diffs).where((F.col("kind") == "line") & (F.col("file_no") > 0) & (F.col("hunk_no") > 0))
    t = F.col("text")
    kind = F.when(t.startswith("+") & ~t.startswith("+++"), "added").when(t.startswith("-") & ~t.startswith("---"), "deleted").otherwise("context")
    return rows.select("diff_id", "file_no", "hunk_no", "pos", kind.alias("kind"), F.when(kind == "context", t).otherwise(F.substring(t, 2, 1 << 30)).alias("text"))


def hunks(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_no, hunk_no, old and new start, count and end, context)."""
    rows = _numbered(diffs).where((F.col("kind") == "hunk") & (F.col("file_no") > 0))
    part = lambda i: F.regexp_extract("text", HUNK, i)
    count = lambda i: F.when(part(i) == "", F.lit(1)).otherwise(part(i).try_cast("int"))
    rows = rows.select("diff_id", "file_no", "hunk_no", part(1).cast("int").alias("old_start"), count(2).alias("old_count"), part(3).cast("int").alias("new_start"), count(4).alias("new_count"), F.trim(part(5)).alias("context"))
    return rows.withColumn("old_end", F.col("old_start") + F.col("old_count") - 1).withColumn("new_end", F.col("new_start") + F.col("new_count") - 1)


def change_type(old: Column, new: Column) -> Column:
    return F.when(old == "/dev/null", "ADDED").when(new == "/dev/null", "DELETED").when(old != new, "RENAMED").otherwise("MODIFIED")


def file_changes(diffs: DataFrame) -> DataFrame:
    """One row a changed file. change_type goes by the header's paths; change_type_ext also by its mode lines."""
    rows = _numbered(diffs).where("file_no > 0")
    t = F.col("text")
    head = lambda i: F.max(F.when(F.col("kind") == "file", F.regexp_extract(t, FILE, i)))
    inside = (F.col("kind") == "line") & (F.col("hunk_no") > 0)
    outside = (F.col("kind") == "line") & (F.col("hunk_no") == 0)
    out = rows.groupBy("diff_id", "file_no").agg(
        head(1).alias("old_path"), head(2).alias("new_path"), F.max(F.col("kind") == "binary").alias("is_binary"),
        F.count_if(inside & t.startswith("+") & ~t.startswith("+++")).cast("int").alias("added_lines"),
        F.count_if(inside & t.startswith("-") & ~t.startswith("---")).cast("int").alias("deleted_lines"),
        F.max(outside & t.startswith("new file mode")).alias("_new"), F.max(outside & t.startswith("deleted file mode")).alias("_gone"),
    )
    kind = change_type(F.col("old_path"), F.col("new_path"))
    out = out.withColumn("change_type", kind).withColumn("change_type_ext", F.when(F.col("_new"), "ADDED").when(F.col("_gone"), "DELETED").otherwise(kind))
    path = F.when(F.col("change_type") == "DELETED", F.col("old_path")).otherwise(F.col("new_path"))
    return out.withColumn("effective_path", path).withColumn("file_type", file_type(path)).drop("_new", "_gone")


def summary(changes: DataFrame) -> DataFrame:
    of = lambda t: F.count_if(F.col("file_type") == t)
    return changes.groupBy("diff_id").agg(F.count(F.lit(1)).alias("files"), of("JAVA").alias("java"), of("JSP").alias("jsp"), of("CONFIG").alias("config"))


def java_changes(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("file_type") == "JAVA")


def jsp_changes(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("file_type") == "JSP")


def config_changes(changes: DataFrame) -> DataFrame:
    """Configuration alone; is_config_file takes other XML too."""
    return changes.where(F.col("file_type") == "CONFIG")


def is_config_file(file_type: Column) -> Column:
    return file_type.isin("CONFIG", "XML")


def range_size(start: Column, end: Column) -> Column:
    """Lines of a closed range; 0 for one that ends before it starts by a line, as a hunk of no lines does."""
    return end - start + 1


def range_contains(start: Column, end: Column, line: Column) -> Column:
    return (line >= start) & (line <= end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 100) -> DataFrame:
    """Pairs of intervals (start, end; closed) that share the keys and overlap. Both sides are cut into cells of `width`, so
    that the join is an equi-join; a pair is kept in the first cell both have."""
    cells = lambda d, s: d.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"{s}_{c}") for c in d.columns if c not in keys], F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("end")) / width))).alias("_cell"))
    both = cells(left, "l").join(cells(right, "r"), [*keys, "_cell"])
    first = F.greatest(F.floor(F.col("l_start") / width), F.floor(F.col("r_start") / width)) == F.col("_cell")
    return both.where(first & overlaps(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))).drop("_cell")
