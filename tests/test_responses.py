import json

import pytest

from newsloom.operators import responses
from newsloom.plans import preparation


def line(content, custom_id="summary_for_abc_3"):
    body = {"choices": [{"message": {"content": content}}]}
    return json.dumps({"custom_id": custom_id, "response": {"body": body}})


GOOD = {"summarization": "s", "tags": ["a", "b"], "key_insights": []}


@pytest.mark.parametrize(
    "value, outcome",
    [
        (line(json.dumps(GOOD)), "ok"),
        (line("\n " + json.dumps(GOOD) + " \n"), "ok"),
        (line(json.dumps({**GOOD, "more": {"x": [1]}})), "ok"),
        (line('{"summarization":"x","summarization":"s","tags":["a","b"],"key_insights":[]}'), "ok"),
        (line(json.dumps({**GOOD, "summarization": 5})), "invalid_summary"),
        (line(json.dumps({**GOOD, "summarization": None})), "invalid_summary"),
        (line(json.dumps({**GOOD, "tags": ["a", 3]})), "invalid_summary"),
        (line(json.dumps({**GOOD, "tags": ["a", None]})), "invalid_summary"),
        (line(json.dumps({**GOOD, "tags": "a"})), "invalid_summary"),
        (line(json.dumps({"summarization": "s", "tags": []})), "invalid_summary"),
        (line(json.dumps(GOOD) + " and more"), "invalid_summary"),
        (line(json.dumps(GOOD) + json.dumps(GOOD)), "invalid_summary"),
        (line("{'summarization':'s','tags':[],'key_insights':[]}"), "invalid_summary"),
        (line("[1]"), "invalid_summary"),
        (line(""), "invalid_summary"),
        (line(None), "invalid_summary"),
        (line(json.dumps(GOOD), "N/A"), "malformed_id"),
        ('{"response":{"body":{"choices":[]}}}', "malformed_id"),
        ('{"custom_id":"a_b_c_1","response":{"body":{"choices":[]}}}', "no_choices"),
        ('{"custom_id":"a_b_c_1","response":{"body":{"id":1}}}', "no_choices"),
        ('{"custom_id":"a_b_c_1","response":{"body":{}},"error":{"code":"1"}}', "api_error"),
        ('{"custom_id":"a_b_c_1","response":null,"error":{"message":"m"}}', "api_error"),
        ('{"custom_id":"a_b_c_1","error":{}}', "unexpected"),
        ('{"custom_id":"a_b_c_1"}', "unexpected"),
        ('{"custom_id":"a_b_c_1"} tail', "undecodable"),
        ('{"custom_id":', "undecodable"),
        ("", "undecodable"),
    ],
)
def test_outcomes(spark, value, outcome):
    row = responses.classify_responses(spark.createDataFrame([(value,)], "value string")).first()
    assert row.outcome == outcome
    if outcome == "ok":
        assert (row.summarization, row.tags, row.key_insights) == ("s", ["a", "b"], [])
        assert (row.link_hash, row.order_id) == ("abc", "3")


def test_folder_to_summary_file(spark, tmp_path):
    folder = tmp_path / "answers"
    folder.mkdir()
    (folder / "one.jsonl").write_text(line(json.dumps(GOOD)) + "\n{broken\n")
    (folder / "two.jsonl").write_text(line(json.dumps(GOOD), "summary_for_def_0") + "\n")
    out, refused = str(tmp_path / "summaries.jsonl"), str(tmp_path / "refused.jsonl")
    counts = preparation.parse_responses(spark, str(folder), out, refused)
    assert {r.outcome: r.n_lines for r in counts.collect()} == {"ok": 2, "undecodable": 1}
    written = spark.read.json(out)
    assert {r.link_hash for r in written.collect()} == {"abc", "def"}
    assert set(written.columns) == {"tags", "key_insights", "link_hash", "order_id", "custom_id", "summarization"}
    assert [r.value for r in spark.read.json(refused).collect()] == ["{broken"]


def test_quality_rules(spark):
    rows = [
        ("word " * 150, ["a", "b", "c"], ["One thing.", "Two.", "Three."]),
        ("word", ["A b", "c", "x!"], ["no capital."]),
        ("word " * 150, [], ["Ends without stop"]),
    ]
    df = spark.createDataFrame(rows, "summarization string, tags array<string>, key_insights array<string>")
    got = {r.rule: (r.n_kept, r.n_broken) for r in responses.summary_quality(df).collect()}
    assert got == {
        "tags_3_to_10": (2, 1),
        "tags_lower_case": (2, 1),
        "tags_without_blanks": (2, 1),
        "tags_1_to_3_words": (3, 0),
        "insights_3_to_10": (1, 2),
        "insights_start_capital": (2, 1),
        "insights_end_full_stop": (2, 1),
        "words_100_to_500": (2, 1),
    }
