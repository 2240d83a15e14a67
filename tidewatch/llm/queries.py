"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat_format, cover_tree, language_id, minhash, mixing, multiset_hash, oracle, packing, pii, pu_quality, quality_rules, suffix_dedup, tiered_search, vector_codes
from tidewatch.llm.common import held_out, table

#: Conversation -7: both turns hold the template's own marks.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as prefix-target examples; the digests are read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    made = chat_format.format_conversations(turns.unionByName(extra))
    read = made.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    digest = read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "formatted",
        F.explode_outer("examples").alias("e"),
    )
    replies = digest.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        "formatted_chars",
        F.col("e.number").alias("number"),
        F.substring("formatted", F.lit(1), F.col("e.end")).alias("example"),
        F.col("e.loss_start").alias("loss_start"),
        F.col("e.loss_end").alias("loss_end"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        "formatted_chars",
        F.when(
            F.col("number").isNotNull(),
            F.struct("number", chat_format.unescape(F.substring("example", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("text")),
        ).alias("reply"),
    )
    learned = replies.groupBy("conv_id", "n_turns", "turns_sha256", "formatted_chars").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("reply")), lambda r: r["text"]), "").alias("learned")
    )
    return learned.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def word_tokenizer_path() -> str:
    """Where the public tokenizer's file lies; nothing is copied from it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rules and cross-document line frequency over all documents."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Scores from here on count as good.
GOOD = 0.7


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from trusted positives and unlabelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = docs.where(~held_out(F.col("doc_id"))).select("doc_id")
    scored = pu_quality.score(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), learn)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings."""
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring the domains' token totals to their target weights."""
    rated = mixing.copies(mixing.rates(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))
    return rated.select("doc_id", "n_tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)], "rate", "copies")


def op6_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long repeats across all documents, removed where a smaller id has them."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, and the errors that they make."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    made = multiset_hash.edited(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        multiset_hash.to_hex(F.col("vector")).alias("fingerprint"),
        multiset_hash.to_hex(F.col("edited_vector")).alias("edited_fingerprint"),
        multiset_hash.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        multiset_hash.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 of all documents for each benchmark item."""
    return tiered_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op11_hamerly_codes": op11_hamerly_codes,
    "op12_multiset_fingerprints": op12_multiset_fingerprints,
    "op13_tiered_search": op13_tiered_search,
    "op6_run_index": op6_run_index,
    "op2_mixing": op2_mixing,
    "op5_cover_tree": op5_cover_tree,
    "op10_minhash": op10_minhash,
    "op4_pii": op4_pii,
    "op1_quality_classifier": op1_quality_classifier,
    "op7_language_id": op7_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op8_packing": op8_packing,
    "op9_chat_format": op9_chat_format,
}

_TEMPLATE = "'### ' || replace(replace(replace(replace(role, chr(92), chr(92) || 'b'), '#', chr(92) || 'h'), '<', chr(92) || 'l'), ':', chr(92) || 'c') || ': ' || replace(replace(replace(text, chr(92), chr(92) || 'b'), '#', chr(92) || 'h'), '<', chr(92) || 'l') || '</turn>' || chr(10)"

ORACLE_SQL = {
    "op11_hamerly_codes": oracle.CODES,
    "op12_multiset_fingerprints": oracle.MULTISET,
    "op13_tiered_search": oracle.RANKED,
    "op3_quality_rules": oracle.QUALITY_RULES,
    "op6_run_index": oracle.REPEATS,
    "op10_minhash": oracle.NEAR_DUPLICATES,
    "op5_cover_tree": """
WITH RECURSIVE vecs AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN deg ON deg.a = e.vec_id LEFT JOIN comp ON comp.a = e.vec_id""",
    "op9_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length({_TEMPLATE})) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM whole""",
}
