import json
from datetime import date

import pytest

from newsloom.operators import extract, pages
from newsloom.plans import preparation
from newsloom.sources import jsonl

from spark_plans import plan_of
from corpus import key


def written_lines(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text(encoding="utf-8").splitlines()]


def test_extract_category_to_file(spark, tmp_path):
    rows = [
        ("SCIENCE", "https://example.com/1", "h1", "2015-01-01"),
        ("SCIENCE", "https://example.com/2", "h2", "2014-12-31"),
        ("SPORTS", "https://example.com/3", "h3", "2016-01-01"),
        ("SCIENCE", "https://example.com/4https://example.com/5", "h4", "2016-01-01"),
        ("SCIENCE", "https://example.com/ü", "h6", "2017-05-06"),
    ]
    names = ("category", "link", "headline", "date")
    dump = tmp_path / "dump.json"
    dump.write_text("".join(json.dumps({**dict(zip(names, r)), "authors": "x"}) + "\n" for r in rows))
    out = tmp_path / "science.jsonl"
    preparation.extract_category(spark, str(dump), str(out))
    got = [json.loads(line) for line in written_lines(out)]
    assert sorted((r["link"], r["date"], r["link_hash"]) for r in got) == [
        ("https://example.com/1", "2015-01-01", key("https://example.com/1")),
        ("https://example.com/ü", "2017-05-06", key("https://example.com/ü")),
    ]
    assert not any("\\/" in line for line in written_lines(out))
    assert {r.link for r in jsonl.read_links(spark, str(out)).collect()} == {r["link"] for r in got}


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "dump")
    spark.sql("SELECT 'SCIENCE' category, 'l' link, 'h' headline, DATE'2016-01-01' date, 'x' more").write.parquet(path)
    plan = plan_of(extract.select_category(spark.read.parquet(path), first_day=date(2015, 1, 1)))
    assert "EqualTo(category,SCIENCE)" in plan and "GreaterThanOrEqual(date,2015-01-01)" in plan
    assert "more" not in plan


def test_names_of_link_files(spark, tmp_path):
    with pytest.raises(ValueError):
        jsonl.read_links(spark, str(tmp_path / "links.json"))
    with pytest.raises(FileNotFoundError):
        jsonl.read_links(spark, str(tmp_path / "none.jsonl"))
    with pytest.raises(ValueError):
        jsonl.append_new(spark.createDataFrame([("a",)], "link_hash string"), str(tmp_path / "x.json"))


def test_append_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    first = spark.createDataFrame([("a", "ä/1"), ("b", "2")], "link_hash string, content string")
    more = spark.createDataFrame([("b", "2"), ("c", "3")], "link_hash string, content string")
    for df in (first, first, more, more):
        jsonl.append_new(df, path)
    rows = spark.read.json(path).collect()
    assert sorted((r.link_hash, r.content) for r in rows) == [("a", "ä/1"), ("b", "2"), ("c", "3")]


def test_pages_keep_their_failures(spark, tmp_path):
    fetched = spark.createDataFrame(
        [("https://example.com/1", "<p>Hi &amp; bye</p>"), ("https://example.com/2", ""), ("https://example.com/3", None)],
        "link string, html string",
    )
    links = spark.createDataFrame([(f"https://example.com/{n}",) for n in (1, 2, 3, 4)], "link string")
    out = str(tmp_path / "content.jsonl")
    for _ in range(2):
        preparation.texts_of_pages(fetched, links, out)
    rows = {r.link[-1]: r for r in spark.read.json(out).collect()}
    assert len(rows) == 4 and spark.read.json(out).count() == 4
    assert rows["1"].content == "Hi & bye" and rows["1"].status == "ok"
    assert {rows[n].status for n in "234"} == {"Failed to fetch"}
    assert all(rows[n].link_hash == key(f"https://example.com/{n}") for n in rows)


def test_a_page_that_breaks_the_parser_stays(spark, monkeypatch):
    def broken(html):
        raise RuntimeError("odd page")

    monkeypatch.setattr(pages, "html_to_text", broken)
    df = spark.createDataFrame([("l", "<p>")], "link string, html string")
    assert pages.page_text(df).first().status == "Parsing failed: odd page"
