"""The registered lookup query over tables of its own."""

from newsloom.workload.cases import CASES


def test_summaries_of_articles_without_vectors(spark, tmp_path):
    """Every stored article has its summary, with a vector (1), without (2, 3 twice) or beyond the documents (4)."""
    documents = [(1, "a", "en", "Text one here"), (2, "b", "fr", "Text two here"), (3, "b", "fr", "Text three"), (3, "b", "fr", "Text three")]
    spark.createDataFrame(documents, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "https://example.com/none")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = CASES["article_lookup"](spark, str(tmp_path)).collect()
    assert sorted((r.link or "", r.summarization) for r in rows) == [
        ("", None),
        ("https://example.com/entry/1", "Text one here"),
        ("https://example.com/entry/2", "Text two here"),
        *[("https://example.com/entry/3", "Text three")] * 4,
        ("https://example.com/entry/4", "Entry 4 has a vector and no document"),
    ]
