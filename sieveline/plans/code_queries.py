"""Queries on files, chunkers, text windows and diffs, with their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_of, line_slice, lines, words, window_starts
from ..operators import chunks, diff, hybrid
from ..operators.vectors import hash_embedding
from ..functions.text import tokens
from ..sources.files import file_type as type_of
from ..sources.files import parser_for
from .corpora import PATHS, diffs, files, table
from .registry import query

VALUES = "(VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ") AS t(path)"
NAME = r"regexp_extract(path, '([^/]*)$', 1)"


def _paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


@query(rf"""SELECT path, CASE WHEN lower({NAME}) IN ('web.xml', 'struts-config.xml', 'tiles-defs.xml') OR (contains(lower({NAME}), 'struts') AND ends_with(lower({NAME}), '.xml')) THEN 'config'
WHEN ends_with(path, '.java') THEN 'java' WHEN regexp_matches(lower({NAME}), '\.jspx?$') THEN 'jsp' END AS parser FROM {VALUES}""")
def file_routing(spark, sf_dir):
    return _paths(spark).select("path", parser_for(F.col("path")).alias("parser"))


@query(rf"""SELECT path, CASE WHEN ends_with(lower(path), '.java') THEN 'JAVA' WHEN regexp_matches(lower(path), '\.jspx?$') THEN 'JSP'
WHEN ends_with(lower(path), '.xml') THEN CASE WHEN contains(path, '/') AND ({NAME} IN ('web.xml', 'struts-config.xml', 'tiles-defs.xml') OR contains({NAME}, 'struts')) THEN 'CONFIG' ELSE 'XML' END
WHEN ends_with(lower(path), '.properties') THEN 'PROPERTIES' WHEN ends_with(lower(path), '.sql') THEN 'SQL' WHEN ends_with(lower(path), '.js') THEN 'JAVASCRIPT' WHEN ends_with(lower(path), '.css') THEN 'CSS' ELSE 'OTHER' END AS file_type FROM {VALUES}""")
def file_type(spark, sf_dir):
    return _paths(spark).select("path", type_of(F.col("path")).alias("file_type"))


LINES = r"string_split(regexp_replace(coalesce(text, ''), '\n+$', ''), chr(10))"
SIZE, STEP = 5, 4


@query(f"""SELECT doc_id, CAST(s AS INTEGER) AS start_line, CAST(least(s + {SIZE - 1}, n) AS INTEGER) AS end_line, array_to_string(l[s:least(s + {SIZE - 1}, n)], chr(10)) AS content
FROM (SELECT doc_id, {LINES} AS l, len({LINES}) AS n FROM documents), unnest(range(1, CAST(2 + {STEP} * greatest(ceil((n - {SIZE}) / {STEP}), 0) AS BIGINT), {STEP})) AS u(s)""")
def sliding_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(lines(F.col("text"))).alias("n"))
    w = d.select("doc_id", "text", "n", F.explode(window_starts(F.col("n"), SIZE, STEP)).alias("start_line"))
    end = F.least(F.col("start_line") + SIZE - 1, F.col("n"))
    return w.select("doc_id", "start_line", end.alias("end_line"), line_slice(F.col("text"), F.col("start_line"), end).alias("content"))


@query("""SELECT doc_id, CAST(1 + length(left(text, p - 1)) - length(replace(left(text, p - 1), chr(10), '')) AS INTEGER) AS line, CAST(1 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS n_lines
FROM (SELECT doc_id, text, instr(text, 'the') AS p FROM documents) WHERE p > 0""")
def line_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.locate("the", "text").alias("p")).where("p > 0")
    return d.select("doc_id", line_of(F.col("text"), F.col("p")).alias("line"), line_of(F.col("text"), F.length("text") + 1).alias("n_lines"))


@query(r"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9_]*$')), ' ') AS calls FROM documents""")
def api_call_sequence(spark, sf_dir):
    """Capitalised words stand for calls in prose: in order, repeats kept."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.filter(words(F.col("text")), lambda w: w.rlike(r"^[A-Z][A-Za-z0-9_]*$")), " ").alias("calls"))


@query("SELECT doc_id, sha256(source || '/' || doc_id || chr(35) || lang) AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.concat("source", F.lit("/"), "doc_id", F.lit("#"), "lang"), 256).alias("chunk_id"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?s)<p>([^<]*)</p>')) AS INTEGER) AS paragraphs, CAST(len(list_filter(regexp_extract_all(html, '(?s)<p>([^<]*)</p>', 1), lambda x: length(x) > 50)) AS INTEGER) AS long_sections FROM pages""")
def html_sections(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r"(?s)<p>([^<]*)</p>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("paragraphs"), F.size(F.filter(found, lambda x: F.length(x) > 50)).alias("long_sections"))


def _chunks(spark: SparkSession, parse, where) -> DataFrame:
    return chunks.chunks(files(spark).where(where), parse)


#: What the literal files hold, written down by hand: file, type, name, first and last line.
JAVA_ROWS = """('src/LoginAction.java', 'CLASS', 'com.acme.web.LoginAction', 3, 13), ('src/LoginAction.java', 'METHOD', 'com.acme.web.LoginAction.execute', 6, 11),
('src/LoginAction.java', 'FIELD', 'com.acme.web.LoginAction.NAME', 5, 5), ('src/LoginAction.java', 'CLASS', 'com.acme.web.Inner', 12, 12), ('src/LoginAction.java', 'METHOD', 'com.acme.web.Inner.size', 12, 12),
('src/Long.java', 'CLASS', 'Long', 1, 154), ('src/Long.java', 'METHOD', 'Long.run', 2, 101), ('src/Long.java', 'METHOD', 'Long.run', 77, 153), ('src/Broken.java', 'ERROR', NULL, NULL, NULL)"""
JSP_ROWS = ", ".join(f"('web/login.jsp', 'JSP_FRAGMENT', 'login.jsp#{kind}', {line}, {line})" for kind, line in (("DIRECTIVE", 1), ("DIRECTIVE", 2), ("SCRIPTLET", 3), ("EXPRESSION", 3), ("FORM", 4), ("LOGIC", 5), ("BEAN", 5), ("INCLUDE", 5), ("SECTION", 6)))
CONFIG_ROWS = ", ".join(
    f"('{path}', 'CONFIG_SECTION', '{path.rpartition('/')[2]}{'#' * bool(kind)}{kind}', {first}, {last})"
    for path, kind, first, last in (
        *(("WEB-INF/web.xml", k, n, n) for k, n in (("servlet", 1), ("servlet_mapping", 2), ("filter", 3), ("filter_mapping", 3))),
        *(("WEB-INF/struts-config.xml", k, n, n) for k, n in (("form_bean", 1), ("action", 2), ("forward", 2), ("forward", 3))),
        *(("WEB-INF/tiles-defs.xml", "tile_definition", n, n) for n in (1, 2)),
        ("conf/my-struts.xml", "", 1, 3),
    )
)
PLACES = "SELECT * FROM (VALUES {}) AS t(file_path, type, fqn, start_line, end_line)"


def _places(found: DataFrame) -> DataFrame:
    return found.select("file_path", F.when(F.col("error").isNotNull(), "ERROR").otherwise(F.col("type")).alias("type"), "fqn", "start_line", "end_line")


@query(PLACES.format(f"{JAVA_ROWS}, {JSP_ROWS}, {CONFIG_ROWS}, ('conf/bad/web.xml', 'ERROR', NULL, NULL, NULL)"))
def all_chunks(spark, sf_dir):
    return _places(_chunks(spark, chunks.parse_any, F.lit(True)))


def _java(spark: SparkSession) -> DataFrame:
    return _chunks(spark, chunks.parse_java, F.col("path").endswith(".java"))


@query(PLACES.format(JAVA_ROWS))
def java_chunks(spark, sf_dir):
    return _places(_java(spark))


@query("SELECT 'com.acme.web.LoginAction.execute' AS fqn, '/login' AS action_path, 'execute' AS action_method")
def java_mvc(spark, sf_dir):
    return _java(spark).where(F.size("mvc") > 0).select("fqn", F.col("mvc.actionPath").alias("action_path"), F.col("mvc.actionMethod").alias("action_method"))


@query("SELECT * FROM (VALUES ('com.acme.web.Inner.size', 1), ('com.acme.web.LoginAction.execute', 3), ('Long.run', 1), ('Long.run', 1)) AS t(fqn, complexity)")
def complexity(spark, sf_dir):
    return _java(spark).where("type = 'METHOD'").select("fqn", F.get_json_object("metadata_json", "$.complexity").cast("int").alias("complexity"))


def _jsp(spark: SparkSession, *kinds: str) -> DataFrame:
    found = _chunks(spark, chunks.parse_jsp, F.lower("path").rlike(r"\.jspx?$")).withColumn("kind", F.get_json_object("metadata_json", "$.fragmentType"))
    return found.where(F.col("kind").isin(*kinds)) if kinds else found


@query(PLACES.format(JSP_ROWS))
def jsp_chunks(spark, sf_dir):
    return _places(_jsp(spark))


@query("SELECT * FROM (VALUES (1, 'page', NULL), (2, 'page', 'page.jsp')) AS t(start_line, directive, include_path)")
def jsp_directives(spark, sf_dir):
    return _jsp(spark, "DIRECTIVE").select("start_line", F.get_json_object("metadata_json", "$.directiveType").alias("directive"), F.col("mvc.includePath").alias("include_path"))


@query("SELECT * FROM (VALUES ('SCRIPTLET', 'user.getName();', 'user.getName'), ('EXPRESSION', 'total', '')) AS t(kind, code, calls)")
def jsp_scriptlets(spark, sf_dir):
    return _jsp(spark, "SCRIPTLET", "EXPRESSION").select("kind", F.get_json_object("metadata_json", "$.javaCode").alias("code"), F.array_join("api_calls", " ").alias("calls"))


@query("SELECT '/login' AS action, 'post' AS method, 1 AS fields")
def jsp_forms(spark, sf_dir):
    return _jsp(spark, "FORM").select(F.col("mvc.actionPath").alias("action"), F.col("mvc.httpMethod").alias("method"), F.get_json_object("metadata_json", "$.fieldCount").cast("int").alias("fields"))


@query("SELECT * FROM (VALUES ('LOGIC', 'equal', 'b', 'p'), ('BEAN', 'write', 'b', 'q')) AS t(kind, tag, bean, property)")
def jsp_tags(spark, sf_dir):
    return _jsp(spark, "LOGIC", "BEAN").select("kind", F.coalesce("mvc.logicType", "mvc.beanType").alias("tag"), F.col("mvc.beanName").alias("bean"), F.col("mvc.beanProperty").alias("property"))


@query("SELECT '/foot.jsp' AS target, 'jsp:include' AS kind")
def jsp_includes(spark, sf_dir):
    return _jsp(spark, "INCLUDE").select(F.col("mvc.targetPage").alias("target"), F.col("mvc.includeType").alias("kind"))


def _config(spark: SparkSession, name: str | None = None) -> DataFrame:
    found = _chunks(spark, chunks.parse_config, F.col("path").endswith(".xml")).withColumn("kind", F.get_json_object("metadata_json", "$.configType"))
    return found.where(F.col("file_path").endswith(name) & F.col("error").isNull()) if name else found


@query("SELECT * FROM (VALUES ('WEB-INF/web.xml', 4, 0), ('WEB-INF/struts-config.xml', 4, 0), ('WEB-INF/tiles-defs.xml', 2, 0), ('conf/my-struts.xml', 1, 0), ('conf/bad/web.xml', 0, 1)) AS t(file_path, n, errors)")
def config_dispatch(spark, sf_dir):
    return _config(spark).groupBy("file_path").agg(F.count("chunk_id").alias("n"), F.count("error").alias("errors"))


@query("SELECT * FROM (VALUES ('servlet', 's', 'S'), ('servlet_mapping', 's', '*.do'), ('filter', 'f', 'F'), ('filter_mapping', 'f', '/*')) AS t(kind, name, target)")
def config_web(spark, sf_dir):
    return _config(spark, "web.xml").select("kind", F.coalesce("mvc.servletName", "mvc.filterName").alias("name"), F.coalesce("mvc.servletClass", "mvc.filterClass", "mvc.urlPattern").alias("target"))


@query("SELECT * FROM (VALUES ('action', '/login', 'LoginAction'), ('form_bean', 'lf', 'LF'), ('forward', 'ok', '/ok.jsp'), ('forward', 'home', '/')) AS t(kind, name, target)")
def config_struts(spark, sf_dir):
    m = lambda *k: F.coalesce(*[F.col(f"mvc.{x}") for x in k])
    return _config(spark, "struts-config.xml").select("kind", m("actionPath", "formBeanName", "forwardName").alias("name"), m("actionClass", "formBeanClass", "forwardPath").alias("target"))


@query("SELECT * FROM (VALUES ('base', '/layout.jsp', NULL), ('page', NULL, 'base')) AS t(name, template, parent)")
def config_tiles(spark, sf_dir):
    return _config(spark, "tiles-defs.xml").select(F.col("mvc.tileName").alias("name"), F.col("mvc.template").alias("template"), F.col("mvc.extends").alias("parent"))


@query("SELECT 'conf/my-struts.xml' AS file_path, 1 AS start_line, 3 AS end_line, 'x' AS root")
def config_generic(spark, sf_dir):
    return _config(spark).where("kind = 'generic_xml'").select("file_path", "start_line", "end_line", F.get_json_object("metadata_json", "$.rootElement").alias("root"))


# --- diffs -------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (1, 'bitbucket.example', 'team', 'shop', 'abc123', NULL, NULL), (2, 'host.example', 'w', 'r', '0f', 'src/A.java', NULL), (3, NULL, NULL, NULL, NULL, NULL, 'not a commit address')) AS t(diff_id, host, workspace, repository, commit, file, error)")
def url_parse(spark, sf_dir):
    return diffs(spark).select("diff_id", diff.parse_url(F.col("url")).alias("u")).select("diff_id", "u.*")


@query("SELECT * FROM (VALUES (1, 'abc123', 'fix login', 'A. Dev', '2024-01-02T03:04:05+00:00', 'p1 p2'), (2, '0f', '', '', '', ''), (3, '', '', '', '', '')) AS t(diff_id, hash, message, author, date, parents)")
def commit_json(spark, sf_dir):
    c = diffs(spark).select("diff_id", diff.parse_commit(F.col("commit_json")).alias("c")).select("diff_id", "c.*")
    return c.withColumn("parents", F.array_join("parents", " "))


FILE_ROWS = """SELECT * FROM (VALUES (1, 1, 'src/web/LoginAction.java', 'MODIFIED', 'MODIFIED', 'JAVA', false, 3, 2), (1, 2, 'web.xml', 'MODIFIED', 'MODIFIED', 'XML', false, 1, 1),
(1, 3, 'WEB-INF/new.jsp', 'RENAMED', 'RENAMED', 'JSP', false, 0, 0), (1, 4, 'img/logo.png', 'MODIFIED', 'MODIFIED', 'OTHER', true, 0, 0), (1, 5, 'conf/struts-config.xml', 'MODIFIED', 'ADDED', 'CONFIG', false, 2, 0)) AS t(diff_id, file_no, effective_path, change_type, change_type_ext, file_type, is_binary, added_lines, deleted_lines)"""


@query(FILE_ROWS)
def diff_files(spark, sf_dir):
    return diff.file_changes(diffs(spark)).drop("old_path", "new_path")


@query("SELECT * FROM (VALUES (1, 1, 'added', 3), (1, 1, 'deleted', 2), (1, 1, 'context', 3), (1, 2, 'added', 1), (1, 2, 'deleted', 1), (1, 5, 'added', 2)) AS t(diff_id, file_no, kind, n)")
def diff_lines(spark, sf_dir):
    return diff.diff_lines(diffs(spark)).groupBy("diff_id", "file_no", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES (1, 1, 'new line'), (1, 1, 'second line'), (1, 1, 'y'), (1, 2, '<b/>'), (1, 5, '<struts-config>'), (1, 5, '</struts-config>')) AS t(diff_id, file_no, text)")
def hunk_lines(spark, sf_dir):
    return diff.diff_lines(diffs(spark)).where("kind = 'added'").select("diff_id", "file_no", "text")


@query("SELECT * FROM (VALUES (1, 1, 1, 10, 13, 10, 14, 'class LoginAction'), (1, 1, 2, 40, 40, 41, 41, ''), (1, 2, 1, 1, 2, 1, 2, ''), (1, 5, 1, 0, -1, 1, 2, '')) AS t(diff_id, file_no, hunk_no, old_start, old_end, new_start, new_end, context)")
def hunk_ranges(spark, sf_dir):
    return diff.hunks(diffs(spark)).select("diff_id", "file_no", "hunk_no", "old_start", "old_end", "new_start", "new_end", "context")


@query("SELECT * FROM (VALUES (1, 1, 1, 4, 5, true), (1, 1, 2, 1, 1, false), (1, 2, 1, 2, 2, false), (1, 5, 1, 0, 2, false)) AS t(diff_id, file_no, hunk_no, old_size, new_size, has_line_12)")
def hunk_sizes(spark, sf_dir):
    h = diff.hunks(diffs(spark))
    old, new = (diff.range_size(F.col(f"{s}_start"), F.col(f"{s}_end")) for s in ("old", "new"))
    return h.select("diff_id", "file_no", "hunk_no", old.alias("old_size"), new.alias("new_size"), diff.range_contains(F.col("new_start"), F.col("new_end"), F.lit(12)).alias("has_line_12"))


@query("SELECT * FROM (VALUES ('java', 'src/web/LoginAction.java'), ('jsp', 'WEB-INF/new.jsp'), ('config', 'conf/struts-config.xml'), ('config or xml', 'web.xml'), ('config or xml', 'conf/struts-config.xml')) AS t(filter, path)")
def diff_filters(spark, sf_dir):
    c = diff.file_changes(diffs(spark))
    parts = {"java": diff.java_changes(c), "jsp": diff.jsp_changes(c), "config": diff.config_changes(c), "config or xml": c.where(diff.is_config_file(F.col("file_type")))}
    rows = [d.select(F.lit(name).alias("filter"), F.col("effective_path").alias("path")) for name, d in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("SELECT 1 AS diff_id, 5 AS files, 1 AS java, 1 AS jsp, 1 AS config")
def diff_summary(spark, sf_dir):
    return diff.summary(diff.file_changes(diffs(spark)))


@query("SELECT * FROM (VALUES (1, 'team', 'fix login', 5), (2, 'w', '', 0), (3, NULL, '', 0)) AS t(diff_id, workspace, message, files)")
def diff_process(spark, sf_dir):
    d = diffs(spark)
    n = diff.file_changes(d).groupBy("diff_id").agg(F.count(F.lit(1)).alias("files"))
    rows = d.select("diff_id", diff.parse_url(F.col("url"))["workspace"].alias("workspace"), diff.parse_commit(F.col("commit_json"))["message"].alias("message"))
    return rows.join(n, "diff_id", "left").withColumn("files", F.coalesce("files", F.lit(0)))


@query("""WITH h AS (SELECT l_orderkey % 50 AS k, l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 3000 AS BIGINT) AS s, CAST(l_partkey % 3000 + l_quantity AS BIGINT) AS e FROM lineitem),
c AS (SELECT p_partkey % 50 AS k, p_partkey AS id, p_partkey AS s, p_partkey + p_size AS e FROM part)
SELECT h.id AS hunk, c.id AS chunk FROM h JOIN c ON h.k = c.k AND h.s <= c.e AND c.s <= h.e""")
def hunk_chunk_overlap(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 3000).alias("start"), (F.col("l_partkey") % 3000 + F.col("l_quantity")).cast("bigint").alias("end"))
    c = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("k"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"))
    return diff.overlap_join(h, c, ["k"], width=50).select(F.col("l_id").alias("hunk"), F.col("r_id").alias("chunk"))


@query()
def retrofit_plan(spark, sf_dir):
    """Each hunk of the diffs as a query on the chunks of the files: where the change belongs."""
    d = diff.diff_lines(diffs(spark)).groupBy("diff_id", "file_no", "hunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("source"))
    q = d.select((F.col("diff_id") * 10000 + F.col("file_no") * 100 + F.col("hunk_no")).cast("bigint").alias("query_id"), "source", F.lit("").alias("hint"), hash_embedding(tokens(F.col("source"))).alias("embedding"))
    c = _chunks(spark, chunks.parse_any, F.lit(True)).where("error IS NULL").select(F.xxhash64("chunk_id").alias("chunk_id"), "content", "type", "file_path", "fqn", F.col("api_calls").alias("calls"), "imports", "mvc")
    v = c.select("chunk_id", hash_embedding(tokens(F.col("content"))).alias("embedding"))
    return hybrid.pattern_search(c, v, q, "METHOD", config=hybrid.RetrievalConfig(threshold=0.0))


@query("SELECT vec_id AS chunk_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def vector_roundtrip(spark, sf_dir):
    """Vectors written as JSON and read again."""
    from ..sources.store import ChunkStore

    store = ChunkStore(spark)
    store.save_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), fmt="json")
    return store.vectors(fmt="json").select("chunk_id", F.size("embedding").alias("dims"))
