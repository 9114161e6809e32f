import json

from newsloom.operators import requests
from newsloom.plans import preparation
from newsloom.sources import jsonl


def content(number, text):
    return {"link": f"https://example.com/{number}", "content": text, "link_hash": f"{number:032x}"}


def test_content_length_limit_counts_characters(spark):
    rows = [
        (0, "l", "é" * 99, "h"),
        (1, "l", "é" * 100, "h"),
        (2, "l", " " * 100, "h"),
        (3, "", "x" * 200, "h"),
        (4, "l", None, "h"),
        (5, "l", "x" * 200, ""),
    ]
    df = spark.createDataFrame(rows, "n bigint, link string, content string, link_hash string")
    got = requests.requests_from_table(df, "n").orderBy("n").collect()
    assert [r.reason for r in got] == ["short", None, None, "malformed", "malformed", "malformed"]
    assert [r.request_number for r in got] == [None, 0, 1, None, None, None]
    assert [r.custom_id for r in got][1:3] == ["summary_for_h_0", "summary_for_h_1"]


def test_files_from_lines(spark, tmp_path):
    lines = []
    for n in range(260):
        if n % 14 == 0:
            lines.append(json.dumps(content(n, "x" * 150)) + " tail")
        elif n % 7 == 0:
            lines.append("{broken")
        elif n % 11 == 0:
            lines.append(json.dumps(content(n, "short")))
        else:
            lines.append(json.dumps(content(n, f'text "{n}" ' + "ü" * 100)))
    source = tmp_path / "content.jsonl"
    source.write_text("\n".join(lines) + "\n", encoding="utf-8")
    out, refused = str(tmp_path / "chunks"), str(tmp_path / "refused.jsonl")
    counts = preparation.prepare_requests(spark, str(source), out, refused)
    good = [n for n in range(260) if n % 7 and n % 11]
    assert {r.outcome: r.n_rows for r in counts.collect()} == {
        "prepared": len(good),
        "undecodable": 38,
        "short": len([n for n in range(260) if n % 7 and n % 11 == 0]),
    }
    assert spark.read.json(refused).count() == 260 - len(good)
    for chunk in range(6):
        files = list((tmp_path / "chunks" / f"chunk_number={chunk}").glob("part-*"))
        assert len(files) == 1
        written = [json.loads(line) for line in files[0].read_text(encoding="utf-8").splitlines()]
        expected = [n for n in good if n // 50 == chunk]
        assert [r["custom_id"] for r in written] == [
            f"summary_for_{n:032x}_{i}" for i, n in enumerate(expected)
        ]
        first = written[0]
        assert first["method"] == "POST" and first["url"] == "/v1/chat/completions"
        assert first["body"]["temperature"] == 0.3
        assert first["body"]["response_format"] == {"type": "json_object"}
        roles = [m["role"] for m in first["body"]["messages"]]
        assert roles == ["system", "user"]
        n = expected[0]
        assert first["body"]["messages"][1]["content"] == (
            f'Summarize the following web article content:\n\ntext "{n}" ' + "ü" * 100
        )


def test_line_order_over_several_blocks(spark, tmp_path):
    source = tmp_path / "content.jsonl"
    source.write_text("".join(json.dumps(content(n, "x" * 150)) + "\n" for n in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        judged = requests.judge_lines(jsonl.content_lines(jsonl.read_lines(spark, str(source))))
        got = requests.requests_from_lines(judged).select("row_index", "link").collect()
        assert judged.select("block_start").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.link.endswith(f"/{r.row_index}") for r in got) and len(got) == 2000
