"""The driver's tables as a chunk table, and small literal corpora of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import capitalised


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: type is the language, calls are capitalised identifiers, the name is source.lang.d<id>."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("lang").alias("type"), F.concat("source", F.lit("/"), "doc_id").alias("file_path"),
        F.concat("source", F.lit("."), "lang", F.lit(".d"), "doc_id").alias("fqn"), capitalised(F.col("text")).alias("calls"), F.array(F.col("source")).alias("imports"),
        F.create_map(F.lit("actionPath"), F.col("source"), F.lit("urlPattern"), F.col("lang")).alias("mvc"), F.concat(F.lit("class D extends "), "lang", F.lit(" implements "), "source").alias("class_context"),
    )


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


DIFF = """diff --git a/src/web/LoginAction.java b/src/web/LoginAction.java
index 1..2 100644
--- a/src/web/LoginAction.java
+++ b/src/web/LoginAction.java
@@ -10,4 +10,5 @@ class LoginAction
 public String execute(String user, int tries) {
-old line
+new line
+second line
--- removed comment
\\ No newline at end of file
@@ -40 +41 @@
-x
+y
diff --git a/web.xml b/web.xml
--- a/web.xml
+++ b/web.xml
@@ -1,2 +1,2 @@
-<a/>
+<b/>
diff --git a/old.jsp b/WEB-INF/new.jsp
similarity index 90%
rename from old.jsp
rename to WEB-INF/new.jsp
diff --git a/img/logo.png b/img/logo.png
Binary files a/img/logo.png and b/img/logo.png differ
diff --git a/conf/struts-config.xml b/conf/struts-config.xml
new file mode 100644
@@ -0,0 +1,2 @@
+<struts-config>
+</struts-config>


"""
COMMIT = '{"hash": "abc123", "message": "fix login", "author": {"user": {"display_name": "A. Dev"}}, "date": "2024-01-02T03:04:05+00:00", "parents": [{"hash": "p1"}, {"hash": "p2"}]}'
DIFFS = [(1, "https://bitbucket.example/team/shop/commit/abc123", COMMIT, DIFF), (2, "http://host.example/w/r/commit/0f/diff/src/A.java", '{"hash": "0f"}', "noise\n"), (3, "ftp://nowhere/commit/zz", "not json", "")]
REPLIES = [
    (1, '{"rankings": [{"chunk_id": "a", "score": 7, "reasoning": "r"}, {"chunk_id": "b", "score": 12, "reasoning": ""}, {"chunk_id": "c", "score": -3, "reasoning": "x"}]}'),
    (2, 'Sure:\n```json\n{"rankings": [{"chunk_id": "a", "score": 4, "reasoning": "ok"}]}\n```'), (3, '{"rankings": [{"chunk_id": "a", "score": 4}]}'), (4, "no json at all"),
    (5, '{"rankings": [{"chunk_id": "a", "score": 1, "reasoning": "r"}, {"chunk_id": "a", "score": 2, "reasoning": "r"}]}'),
]
PATHS = ["src/A.java", "src/B.JAVA", "web/x.jsp", "web/Y.JSPX", "web.xml", "WEB-INF/web.xml", "a/struts-config.xml", "a/my-Struts.xml", "a/tiles-defs.xml", "a/other.xml", "a/b.properties", "q.sql", "s/a.js", "s/a.css", "README", "dir.java/file"]
JAVA = """package com.acme.web;
import java.util.List;
@Controller
public class LoginAction extends BaseAction implements Audited {
    private static final String NAME = "login", OTHER = "x";
    @RequestMapping("/login")
    public String execute(String user, int tries) {
        if (user == null) { return "again"; }
        for (int i = 0; i < tries; i++) { service.find(user).check(i); }
        return audit.log(user);
    }
    interface Inner { int size(); }
}
"""
LONG = "class Long {\n    void run() {\n" + "".join(f"        step({i});\n" for i in range(150)) + "    }\n}\n"
JSP = '<%@ page import="java.util.*" %>\n<%@ include file="page.jsp" %>\n<% user.getName(); %><%= total %>\n<html:form action="/login" method="post"><html:text property="u"/></html:form>\n<logic:equal name="b" property="p" value="1">x</logic:equal><bean:write name="b" property="q"/><jsp:include page="/foot.jsp"/>\n<div id="main">a section with more than fifty visible characters in it, surely</div><div id="small">short</div>\n'
WEB = "<web-app><servlet><servlet-name>s</servlet-name><servlet-class>S</servlet-class><init-param><param-name>k</param-name><param-value>v</param-value></init-param></servlet>\n<servlet-mapping><servlet-name>s</servlet-name><url-pattern>*.do</url-pattern></servlet-mapping>\n<filter><filter-name>f</filter-name><filter-class>F</filter-class></filter><filter-mapping><filter-name>f</filter-name><url-pattern>/*</url-pattern></filter-mapping></web-app>"
STRUTS = '<struts-config><form-beans><form-bean name="lf" type="LF"/></form-beans>\n<action-mappings><action path="/login" type="LoginAction" name="lf" scope="request"><forward name="ok" path="/ok.jsp"/></action></action-mappings>\n<global-forwards><forward name="home" path="/"/></global-forwards></struts-config>'
TILES = '<tiles-definitions><definition name="base" path="/layout.jsp"><put name="head" value="/h.jsp"/></definition>\n<definition name="page" extends="base"/></tiles-definitions>'
FILES = [("src/LoginAction.java", JAVA), ("src/Long.java", LONG), ("src/Broken.java", "class {"), ("web/login.jsp", JSP), ("WEB-INF/web.xml", WEB), ("WEB-INF/struts-config.xml", STRUTS), ("WEB-INF/tiles-defs.xml", TILES), ("conf/my-struts.xml", "<x>\n<y/>\n</x>\n"), ("conf/bad/web.xml", "<web-app>"), ("notes.txt", "x")]


def diffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIFFS, "diff_id int, url string, commit_json string, raw_diff string")


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, text string")


def replies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPLIES, "reply_id int, text string")
