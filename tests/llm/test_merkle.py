from pyspark.sql import functions as F

from newsloom.llm import merkle


def test_edits_and_order(hard_docs, hard_rows):
    from hashlib import sha256

    rows = merkle.fingerprint_edits(hard_docs).collect()
    order = sorted(hard_rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]]):
        text, following = text or "", following or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        want.append((i, len(text), sha256(edited.encode()).hexdigest()))
    assert sorted(map(repr, ((r.doc_id, r.n_chars, r.edited_sha256) for r in rows))) == sorted(map(repr, want))
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))


def test_equal_texts_only(spark, hard_rows):
    texts = [t or "" for _, t in hard_rows] + ["a\x01b", "ab", "a\x01\x02b", "a\x01\x03b", "x. y\nz", "x. y\n\nz"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("tree", merkle.fingerprint(F.col("text")))
    trees = rows.collect()
    assert len({r.tree for r in trees}) == len({r.text for r in trees}) == len({(r.text, r.tree) for r in trees})


def test_differing_branches_locate_edits(spark):
    lines = [f"Line {i} says something, and then more. It ends." for i in range(60)]
    changed = [*lines]
    changed[40] = "Another line. It ends."
    rows = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    row = rows.select(
        merkle.likeness(a, b).alias("like"),
        F.size(merkle.differing_sections(a, b)).alias("differing"),
        F.size(merkle.differing_sections(a, a)).alias("none"),
        F.size(F.split(a, " ")).alias("sections"),
    ).first()
    assert 0.9 < row.like < 1
    assert 1 <= row.differing <= 2 < row.sections - 1
    assert row.none == 0


def test_no_python(hard_docs):
    plan = merkle.fingerprint_edits(hard_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_no_rows(no_docs):
    assert merkle.fingerprint_edits(no_docs).count() == 0
