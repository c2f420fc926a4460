"""The numbered text queries: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from phenogrid.llm import (
    byte_bpe, decontaminate, html_text, katz, minhash_bins, pii, quality_lines, ranked_search, sharding, simhash, spelling, token_files,
    toxicity,
)
from phenogrid.llm.registry import query, table
from phenogrid.session import scratch_path


@query("op1_simhash")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_sharding", sharding.SQL)
def op2(spark, sf_dir):
    """Writes the documents into their shards and reads the placement back from the files."""
    placed = sharding.place(table(spark, sf_dir, "documents"), sharding.document_key(), sharding.shard_names())
    path = scratch_path(spark, "shards")
    sharding.write_shards(placed, path)
    return spark.read.schema(placed.schema).parquet(path).select("doc_id", "slot", "shard")


@query("op4_decontaminate", decontaminate.SQL)
def op4(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


@query("op9_line_frequency", quality_lines.SQL)
def op9(spark, sf_dir):
    return quality_lines.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_pii")
def op10(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", pii.find_spans(F.col("text")).alias("spans"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query("op6_html_text")
def op6(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


@query("op7_toxicity")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = toxicity.in_part("doc_id", 5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), may_learn=part != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_token_files")
def op3(spark, sf_dir):
    """Encodes the documents into a token store and reads every document back from its files."""
    path = scratch_path(spark, "tokens")
    token_files.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_store(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query("op8_byte_bpe")
def op8(spark, sf_dir):
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.col("bpe.token_ids")
    return coded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"))


@query("op5_katz")
def op5(spark, sf_dir):
    part = toxicity.in_part("doc_id", 10)
    found = katz.score(table(spark, sf_dir, "documents"), part != 0)
    return found.select("doc_id", (part == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_ranked_search", ranked_search.SQL)
def op11(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query("op12_minhash_bins")
def op12(spark, sf_dir):
    found = minhash_bins.edited_likeness(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


@query("op13_spelling")
def op13(spark, sf_dir):
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))
