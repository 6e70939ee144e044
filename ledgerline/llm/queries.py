"""The registered queries of the corpus operators, with SQL where SQL can say the same.

Each query applies its operator with production parameters to a whole table and
derives the digest columns of its contract from the operator's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (decontamination, exact_dedup, langid, mixing, pii, quality, sharding, simhash,
                            spelling, suffix_automaton, suffix_index, warc, whitening)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int):
    """The fold of a row: crc32 of the id as text, modulo the number of folds (null: 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score",
                        F.size("spans").alias("n_spans"))


def op2_warc(spark, sf_dir):
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_suffix_array_dedup(spark, sf_dir):
    out = suffix_index.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold("doc_id", 5) != 0))
    rows = quality.score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                       (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))[0]


def op6_decontamination(spark, sf_dir):
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    out = suffix_automaton.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_pii(spark, sf_dir):
    """Counts and digest of the plain (base) spans; ``spans`` adds those of the disguised ones."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s.added)
    of = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in pii.KINDS]
    line = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"),
                        line("spans").alias("spans"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_warc, op3_suffix_array_dedup, op4_quality, op5_sharding, op6_decontamination,
    op7_exact_dedup, op8_mixing, op9_simhash, op10_substring_dedup,
    op11_pii, op12_whitening, op13_spelling_variants)}
