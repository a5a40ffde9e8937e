"""One query for each operator over its whole table, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (alignment, chat, licenses, lines, mining, mixing, packing, pii, quality, rules, simhash, syncmers,
                          vectors)
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_mix_sources(spark, sf_dir):
    rows = mixing.placed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "row.doc_id", "size", "source_size", "target", (F.size("takes") * F.col("size")).alias("taken"),
        F.try_element_at("takes", F.lit(1)).alias("position"), F.try_element_at("takes", F.lit(2)).alias("second_position"))


@query
def op8_personal_data(spark, sf_dir):
    found = pii.detect(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id", *[pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.listing(spans, pii.BASE_KINDS), 256).alias("base_sha256"), pii.listing(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"))


@query
def op9_pack_pieces(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    # A null id can have no label and is not held out.
    out = F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False))
    scored = docs.select("doc_id", out.alias("held_out"), quality.score(model, docs["text"]).alias("score"))
    return scored.select("*", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query
def op1_line_dedup(spark, sf_dir):
    rows = lines.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "text", "lines", F.col("removed").alias("lines_removed"))


ORACLES["op1_line_dedup"] = lines.ORACLE


@query
def op5_simhash(spark, sf_dir):
    groups = simhash.grouped(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_format_chats(spark, sf_dir):
    said = F.lit("</s>[INST] ok [/INST]")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.formatted(turns.unionByName(probe)))


@query
def op2_fingerprints(spark, sf_dir):
    rows = syncmers.compared(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.written(F.col("links")).alias("fingerprint"), syncmers.written(F.col("edited_links")).alias("edited_fingerprint"),
        syncmers.shared(F.col("links"), F.col("edited_links")).alias("near_edited"),
        syncmers.shared(F.col("links"), F.col("next_links")).alias("near_next"), "anchors", "edited_anchors")


@query
def op4_near_vectors(spark, sf_dir):
    rows = vectors.grouped(table(spark, sf_dir, "embeddings"))
    return rows.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op11_align_tokenizers(spark, sf_dir):
    rows = alignment.aligned(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return rows.select(*[c for c in rows.columns if c != "groups"], digest.alias("groups_sha256"))


@query
def op12_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = rules.train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", rules.judged(model, docs["text"]).alias("verdict")).select("doc_id", "verdict.*")


@query
def op13_hard_negatives(spark, sf_dir):
    return mining.mined(table(spark, sf_dir, "embeddings"))


ORACLES["op13_hard_negatives"] = mining.ORACLE
