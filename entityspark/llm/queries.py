"""The registered queries of the text operators: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityspark.llm import alignment, disclosure, exact, language, lm, packing, quality, secrets, simhash, substrings, telephony, whitening, winnowing
from entityspark.llm.textio import fold, table


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold("doc_id", 3) != 1))
    return language.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's decision."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.scanner(docs, docs.where(fold("doc_id", 3) != 1)))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document stored as telephony audio and read back."""
    return telephony.features(telephony.store(table(spark, sf_dir, "documents")))


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it in every document."""
    return disclosure.digests(disclosure.spans_of(table(spark, sf_dir, "documents")))


def op7_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and byte-model scores of every document; learned from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, docs.where(fold("doc_id", 10) != 0))
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.FactorisationMachine:
    """The machine learned from labelled documents of two folds."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    return quality.train(quality.labelled_sample(table(spark, sf_dir, "documents"), labels))


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_backward_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that an earlier one has."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), least=50)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of every document's group of equal texts."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_exact_text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over every document."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector."""
    found = whitening.whitened_components(table(spark, sf_dir, "embeddings"), components=8)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_pivots": op1_simhash_pivots,
    "op2_language_bitmask": op2_language_bitmask,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_forest": op4_secret_forest,
    "op5_telephony_audio": op5_telephony_audio,
    "op6_disclosure": op6_disclosure,
    "op7_partial_matching": op7_partial_matching,
    "op8_factorisation_machine": op8_factorisation_machine,
    "op9_backward_extension": op9_backward_extension,
    "op10_winnowing": op10_winnowing,
    "op11_patricia_owners": op11_patricia_owners,
    "op12_exact_text_alignment": op12_exact_text_alignment,
    "op13_polarisation_whitening": op13_polarisation_whitening,
}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w"

#: The others learn a model, hash with functions that SQL lacks, or pack in sequence; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_winnowing": f"""
WITH d AS (SELECT doc_id, {_WORDS} FROM documents),
b AS (SELECT DISTINCT cast(item_id AS varchar) AS item, {_WORDS} FROM benchmark WHERE item_id IS NOT NULL),
spans AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS span FROM (SELECT item, w, least(len(w), 10) AS m, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM spans),
lists AS (SELECT doc_id, m, list_transform(generate_series(1, len(w) - m + 1), lambda i: array_to_string(w[i:i + m - 1], ' ')) AS s FROM d, sizes WHERE len(w) >= m),
starts AS (SELECT doc_id, m, unnest(s) AS span, generate_subscripts(s, 1) AS i FROM lists),
hits AS (SELECT doc_id, m, i, item FROM starts JOIN spans USING (m, span)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op11_patricia_owners": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
}
