import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import text
from sieveline.operators.chunks import windows
from sieveline.sources.files import file_type, parser_for


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_keep_words_whole(spark):
    assert one(spark, text.tokens(F.lit("Élan vital_2, don't"))) == ["élan", "vital_2", "don", "t"]
    assert one(spark, text.code_tokens(F.lit("com.foo.Bar x-y"))) == ["com.foo.bar", "x", "y"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 600))
def test_windows_cover_every_line_and_overlap(n):
    spans = windows(1, n)
    assert spans[0][0] == 1 and spans[-1][1] == n and all(b[0] == a[0] + 75 and a[1] - b[0] == 24 for a, b in zip(spans, spans[1:]))
    assert len(spans) == max(1, math.ceil((n - 100) / 75) + 1)


def test_window_starts_agree_with_the_scanner(spark):
    rows = spark.range(1, 400).withColumn("s", text.window_starts(F.col("id"), 100, 75)).collect()
    assert all(r.s == [a for a, _ in windows(1, r.id)] for r in rows)


def test_lines_and_slices(spark):
    body = F.lit("a\nb\nc\n\n")
    assert one(spark, text.lines(body)) == ["a", "b", "c"]
    assert one(spark, text.line_slice(body, F.lit(2), F.lit(9))) == "b\nc"
    assert one(spark, text.line_of(body, F.lit(5))) == 3


def test_small_functions(spark):
    assert one(spark, text.package_of(F.lit("a.b.C"))) == "a.b" and one(spark, text.package_of(F.lit("C"))) == ""
    assert one(spark, text.truncated(F.lit("x" * 501))) == "x" * 500 + "..." and one(spark, text.truncated(F.lit("x" * 500))) == "x" * 500
    assert one(spark, text.attribute(F.lit("<a href = 'u' href=\"v\">"), "href")) == "u"
    assert one(spark, text.identifiers(F.lit("return Foo bar Foo if x1 ab2"))) == ["Foo", "bar", "ab2"]


def test_routing_and_types(spark):
    route = lambda p: one(spark, parser_for(F.lit(p)))
    assert [route(p) for p in ("a/B.java", "a/B.JAVA", "x.JSPX", "q/Struts-x.XML", "web.xml", "a.xml")] == ["java", None, "jsp", "config", "config", None]
    assert [one(spark, file_type(F.lit(p))) for p in ("web.xml", "w/web.xml", "a.jsp", "x")] == ["XML", "CONFIG", "JSP", "OTHER"]
