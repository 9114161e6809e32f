"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import small

# A clause ends after these marks and a blank, after a line break, or after so many characters.
CLAUSE_END = r"([.!?;,|:] |\n)"
CLAUSE_CHARS = 200
_ESCAPE, _PLAIN, _CUT = "\x01", "\x01\x02", "\x01\x03"


def fingerprint(text: Column) -> Column:
    """The tree of a text as one string: ``root section ...``, a section as ``hash:paragraph;...``.

    Leaves are clauses, 8 hex digits of their hash each; a paragraph is a line; a
    section ends after a paragraph whose hash begins with 0 or 1, so an edit moves no
    border but its own. A section's hash covers its leaves' longer hashes, the root the
    sections' hashes. A null text counts as empty; the empty text is one empty clause.
    """
    cut = F.replace(F.coalesce(text, F.lit("")), F.lit(_ESCAPE), F.lit(_PLAIN))
    cut = F.regexp_replace(cut, CLAUSE_END, "$1" + _CUT)
    cut = F.regexp_replace(cut, rf"([^.!?;,|:\n\x01]{{{CLAUSE_CHARS}}})", "$1" + _CUT)
    leaf = lambda c: F.concat(F.substring(F.md5(c), 1, 16), F.when(c.endswith("\n"), ";").otherwise(","))
    lines = F.array_join(F.transform(F.split(cut, _CUT), leaf), "")
    ended = lambda p: F.concat(p, F.when(F.substring(F.md5(p), 1, 1) < "2", " ").otherwise(";"))
    tree = F.array_join(F.transform(F.split(lines, ";"), ended), "")
    section = lambda s: F.concat(
        F.substring(F.sha2(s, 256), 1, 16), F.lit(":"), F.regexp_replace(s, "([0-9a-f]{8})[0-9a-f]{8},?", "$1")
    )
    sections = F.transform(F.filter(F.split(tree, " "), lambda s: s != ""), section)
    return F.concat_ws(" ", F.sha2(tree, 256), F.array_join(sections, " "))


def root(tree: Column) -> Column:
    return F.substring_index(tree, " ", 1)


def _sections(tree: Column) -> Column:
    return F.slice(F.split(tree, " "), 2, 1_000_000_000)


def differing_sections(tree: Column, other: Column) -> Column:
    """The sections of ``tree`` that ``other`` does not have: where an edit lies."""
    return F.when(root(tree) == root(other), F.array().cast("array<string>")).otherwise(
        F.array_except(_sections(tree), _sections(other))
    )


def likeness(tree: Column, other: Column) -> Column:
    """Share of clauses that two trees have in common, 0 to 1.

    Equal roots end the comparison, equal sections are not opened; below differing
    sections the clauses are met. The share is of the larger tree's distinct clauses.
    """
    mine, theirs = _sections(tree), _sections(other)
    same = F.array_intersect(mine, theirs)
    rest = F.array_intersect(_leaves(F.array_except(mine, same)), _leaves(F.array_except(theirs, same)))
    common = F.size(F.array_union(_leaves(same), rest))
    larger = F.greatest(F.size(F.array_distinct(_leaves(mine))), F.size(F.array_distinct(_leaves(theirs))))
    return F.when(root(tree) == root(other), F.lit(1.0)).otherwise(common / larger)


def _leaves(sections: Column) -> Column:
    bodies = F.array_join(F.transform(sections, lambda s: F.substring_index(s, ":", -1)), "")
    return F.regexp_extract_all(bodies, F.lit("[0-9a-f]{8}"), F.lit(0))


def _bucket(column: Column, bounds: list[int]) -> Column:
    """Number of the range that a value lies in, by a search of two levels; null lies in the first."""
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not groups:
        return F.lit(0)
    long = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    passed = lambda values: F.size(F.filter(values, lambda b: b <= column))
    group = passed(long([g[0] for g in groups]))
    inside = passed(F.element_at(F.array(*[long(g) for g in groups]), group))
    return F.when((group == 0) | column.isNull(), 0).otherwise((group - 1) * width + inside)


def with_next(docs: DataFrame, rows_per_bucket: int = 200_000) -> DataFrame:
    """``doc_id, text, fingerprint, next_text, next_fingerprint`` in ascending order of ``doc_id``.

    After the last row comes the first. Null ids come first, equal ids in the order of
    their texts. Rows are dealt into ranges of ids and texts cross the network once;
    each range also gets the first row of the range after it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(total // 1000 + 1, max(4 * partitions, total // rows_per_bucket + 1)))
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10 * buckets)).first()[0] if shares else None
    bounds = sorted(set(found or []))
    placed = rows.withColumn("bucket", _bucket(F.col("doc_id"), bounds)).withColumn("added", F.lit(0))
    least = placed.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("least"))
    # One row for each range, so the broadcast and the window below stay small.
    least = small(least.select(F.col("bucket").alias("_bucket"), F.col("least.doc_id").alias("_id")), buckets)
    same = (F.col("bucket") == F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    firsts = placed.join(least, same).groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    order = Window.orderBy("bucket")
    ends = firsts.select(
        F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"),
        "first.*",
    )
    both = placed.unionByName(ends.withColumn("added", F.lit(1))).withColumn("fingerprint", fingerprint(F.col("text")))
    following = Window.partitionBy("bucket").orderBy("added", F.col("doc_id").asc_nulls_first(), "text")
    return both.select(
        "doc_id", "text", "fingerprint", "added",
        F.lead("text").over(following).alias("next_text"),
        F.lead("fingerprint").over(following).alias("next_fingerprint"),
    ).where("added = 0").drop("added")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside that of an edited text and of the next document.

    The edit replaces the last quarter of the code points by the first as many of the
    next document. Null and empty texts are one empty clause; repeated rows stay and
    follow each other; a table of one row follows itself; an empty table gives no
    rows; other columns are not looked at.
    """
    rows = with_next(docs)
    n = F.length("text").cast("long")
    edited = rows.withColumn("n_chars", n).withColumn("_moved", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = edited.withColumn(
        "edited", F.concat(F.expr("left(text, n_chars - _moved)"), F.expr("left(next_text, _moved)"))
    ).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
