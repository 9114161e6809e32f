"""The registered queries of these operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import alignment, chat, embeddings, jaccard, merkle, packing, pieces, private, secrets, shards, suffixes, toxicity, variants
from newsloom.runtime import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
    """Register a query; it gets the session and a reader of the tables by name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return build(spark, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

    QUERIES[build.__name__] = run
    return build


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_shards(spark, table):
    return shards.shard_documents(table("documents"), 24)


@query
def op7_toxicity(spark, table):
    documents = table("documents")
    return toxicity.score_toxicity(documents, toxicity.fit_toxicity(documents, table("labels")))


@query
def op8_chat(spark, table):
    hard = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    turns = table("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.chat_digests(chat.format_conversations(turns.union(added), tokenizer("byte_bpe_50k.json")))


@query
def op6_secrets(spark, table):
    documents = table("documents")
    return secrets.secret_digests(secrets.find_secrets(documents, secrets.fit_secrets(documents)))


@query
def op1_pieces(spark, table):
    model = tokenizer("piece_bpe_32k.model")
    return pieces.piece_digests(pieces.decode_pieces(pieces.encode_pieces(table("documents"), model), model))


@query
def op5_fingerprints(spark, table):
    return merkle.fingerprint_edits(table("documents"))


def _tree_sql(text: str) -> str:
    """The fingerprint of a text column in DuckDB."""
    cut = f"replace({text}, chr(1), chr(1) || chr(2))"
    cut = f"regexp_replace({cut}, '([.!?;,|:] |\\n)', '\\1' || chr(1) || chr(3), 'g')"
    cut = f"regexp_replace({cut}, '([^.!?;,|:\\n\\x01]{{200}})', '\\1' || chr(1) || chr(3), 'g')"
    lines = (
        f"array_to_string(list_transform(string_split({cut}, chr(1) || chr(3)), lambda c: "
        "substr(md5(c), 1, 16) || CASE WHEN ends_with(c, chr(10)) THEN ';' ELSE ',' END), '')"
    )
    tree = (
        f"array_to_string(list_transform(string_split({lines}, ';'), lambda p: "
        "p || CASE WHEN substr(md5(p), 1, 1) < '2' THEN ' ' ELSE ';' END), '')"
    )
    sections = (
        f"list_transform(list_filter(string_split({tree}, ' '), lambda s: s <> ''), lambda s: substr(sha256(s), 1, 16) "
        "|| ':' || regexp_replace(s, '([0-9a-f]{8})[0-9a-f]{8},?', '\\1', 'g'))"
    )
    return f"sha256({tree}) || ' ' || array_to_string({sections}, ' ')"


def _leaves_sql(sections: str) -> str:
    bodies = f"array_to_string(list_transform({sections}, lambda s: string_split(s, ':')[-1]), '')"
    return f"list_distinct(regexp_extract_all({bodies}, '[0-9a-f]{{8}}'))"


def _likeness_sql(one: str, other: str) -> str:
    mine, theirs = f"string_split({one}, ' ')[2:]", f"string_split({other}, ' ')[2:]"
    return (
        f"CASE WHEN string_split({one}, ' ')[1] = string_split({other}, ' ')[1] THEN 1.0::DOUBLE ELSE "
        f"len(list_intersect({_leaves_sql(mine)}, {_leaves_sql(theirs)}))::DOUBLE / "
        f"greatest(len({_leaves_sql(mine)}), len({_leaves_sql(theirs)})) END"
    )


SQL["op5_fingerprints"] = f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (
  SELECT doc_id, text, length(text) AS n,
         coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM rows WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)
),
edited AS (
  SELECT *, left(text, n - n // 4) || left(next_text, n // 4) AS edited FROM following
),
trees AS (
  SELECT *, {_tree_sql("text")} AS fingerprint, {_tree_sql("edited")} AS edited_fingerprint,
         {_tree_sql("next_text")} AS next_fingerprint
  FROM edited
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       {_likeness_sql("fingerprint", "edited_fingerprint")} AS near_edited,
       {_likeness_sql("fingerprint", "next_fingerprint")} AS near_next
FROM trees
"""


@query
def op4_packing(spark, table):
    return packing.pack_documents(table("documents"), tokenizer("word_bpe_49k.json"))


@query
def op2_jaccard(spark, table):
    return jaccard.document_components(jaccard.jaccard_join(table("documents")))


@query
def op9_suffixes(spark, table):
    return suffixes.repeat_digests(suffixes.remove_repeats(table("documents")))


@query
def op10_vectors(spark, table):
    return embeddings.near_vectors(table("embeddings"))


@query
def op12_variants(spark, table):
    return variants.spelling_variants(table("documents"))


@query
def op13_alignment(spark, table):
    return alignment.alignment_digests(table("documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query
def op11_private(spark, table):
    documents = table("documents")
    return private.private_digests(private.find_private(documents, private.fit_private(documents)))
