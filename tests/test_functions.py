import hashlib

import pytest
from pyspark.sql import functions as F

from newsloom.functions import links, text, vectors
from newsloom.functions.embedder import HashedWords
from newsloom.functions.html_text import html_to_text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first()["r"]


def test_strip_whitespace_of_any_script(spark):
    for raw in ["\n\t a b \r\n", " x ", "\x1cx\x85", "plain", "", "　"]:
        assert one(spark, raw, text.strip_whitespace(F.col("c"))) == raw.strip()


@pytest.mark.parametrize(
    "raw, parts", [("a,b", ["a", "b"]), ("a, b", ["a", " b"]), ("a,,b", ["a", "", "b"]), ("a,", ["a", ""])]
)
def test_split_tags_keeps_blanks_and_empty_parts(spark, raw, parts):
    assert one(spark, raw, text.split_tags(F.col("c"))) == parts == raw.split(",")
    assert one(spark, raw, text.tags_as_text(text.split_tags(F.col("c")))) == "\n ".join(parts)


def test_request_id_parts(spark):
    made = one(spark, 7, text.request_id(F.lit("abc"), F.col("c")), "bigint")
    assert made == "summary_for_abc_7"
    assert one(spark, made, text.request_id_hash(F.col("c"))) == "abc"
    assert one(spark, made, text.request_id_number(F.col("c"))) == "7"
    assert one(spark, "N/A", text.request_id_hash(F.col("c"))) is None


def test_link_hash_is_shake_256(spark):
    assert one(spark, "", links.link_hash("c")) == "46b9dd2b0ba88d13233b3feb743eeb24"
    for link in ["https://example.com/a", "https://example.com/ä?q=ü"]:
        assert one(spark, link, links.link_hash("c")) == hashlib.shake_256(link.encode()).hexdigest(16)
    assert one(spark, None, links.link_hash("c")) is None


@pytest.mark.parametrize(
    "link, corrupted",
    [
        ("https://example.com/a", False),
        ("https://example.com/ahttps://example.com/b", True),
        ("https://example.com/http", True),
        ("httphttp", False),
        ("no link", False),
    ],
)
def test_second_http_marks_a_corrupted_link(spark, link, corrupted):
    assert one(spark, link, links.is_corrupted(F.col("c"))) is corrupted


@pytest.mark.parametrize(
    "link, normalized",
    [
        ("HTTP://Example.COM", "http://example.com/"),
        ("https://Example.com/Path?Q=1#Frag", "https://example.com/Path?Q=1#Frag"),
        ("https://example.com:443/a", "https://example.com/a"),
        ("http://example.com:0080", "http://example.com/"),
        ("http://example.com:8080", "http://example.com:8080/"),
        ("https://me@example.com/a", "https://me@example.com/a"),
        (" https://example.com/a b ", "https://example.com/a%20b"),
        ("https://example.com/é", "https://example.com/%C3%A9"),
        ("https://example.com?x=1", "https://example.com/?x=1"),
        ("ftp://example.com/", None),
        ("example.com", None),
        ("http://", None),
        ("http://example.com:99999/", None),
        ("http://example.com/" + "x" * 2083, None),
        ("", None),
        (None, None),
    ],
)
def test_normalized_link(spark, link, normalized):
    assert one(spark, link, links.normalized_link(F.col("c"))) == normalized
    assert one(spark, link, links.is_valid_link(F.col("c"))) is (normalized is not None)


def test_cosine_distance(spark):
    rows = [
        ([1.0, 0.0], [0.0, 2.0], 1.0),
        ([1.0, 1.0], [2.0, 2.0], 0.0),
        ([1.0, 0.0], [-3.0, 0.0], 2.0),
        ([0.0, 0.0], [1.0, 0.0], None),
        ([1.0], [1.0, 0.0], None),
        (None, [1.0, 0.0], None),
    ]
    df = spark.createDataFrame(rows, "a array<float>, b array<double>, want double")
    for row in df.select(vectors.cosine_distance(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert (row.got is None) == (row.want is None)
        assert row.got is None or abs(row.got - row.want) < 1e-12


def test_unit_vector(spark):
    assert one(spark, [3.0, 4.0], vectors.unit(F.col("c")), "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.unit(F.col("c")), "array<double>") == [None, None]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p> a </p><p>b<b>c</b> d</p>", "a b c d"),
        ("<title>T</title><script>var x='</p>';</script><style>p{}</style><p>x</p>", "T x"),
        ("a<!-- hidden -->b", "a b"),
        ("<!DOCTYPE html><?php x ?><p>y", "y"),
        ("<template><p>no</p></template>yes", "yes"),
        ("<ruby>k<rt>no</ruby>yes", "k yes"),
        ("fish &amp; chips &#169; &#x41; &eacute;", "fish & chips © A é"),
        ("a<br>b<br/>c", "a b c"),
        ("  x  ", "x"),
        ("<div>one\n two</div>", "one\n two"),
        ("<p>open <b>never closed", "open never closed"),
        ("</p>stray", "stray"),
        ("<![CDATA[kept]]>", "kept"),
        ("&unknown; z", "&unknown z"),
        ("<ul>" + "<li>x" * 3000 + "</b>" * 3000, " ".join(["x"] * 3000)),
    ],
)
def test_html_to_text(html, expected):
    assert html_to_text(html) == expected


def test_hashed_words_are_unit_vectors():
    got = HashedWords(32)(["one two two", "", "!!!"])
    assert abs((got[0] ** 2).sum() - 1) < 1e-12
    assert not got[1:].any()
    assert (got == HashedWords(32)(["two ONE two", "", ""])).all()


def test_dot_segments(spark):
    from newsloom.functions.links import without_dot_segments

    cases = {
        "/a/b/c/./../../g": "/a/g", "/a/b/../../../c": "/c", "/..": "/", "/a/.": "/a/", "/a/..": "/",
        "/a/%2E%2e/b": "/b", "/a//b/../c": "/a//c", "/a/b": "/a/b", "": "", "/./x/../y/": "/y/",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "path string").select("path", without_dot_segments(F.col("path")).alias("out"))
    assert {r.path: r.out for r in rows.collect()} == cases
