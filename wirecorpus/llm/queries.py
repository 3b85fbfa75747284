"""The registered query of each operator of this subpackage, and its oracle where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from wirecorpus.llm import (
    compression, divergence, langid, licences, line_crf, packing, periodic, phrases, pieces,
    prefixjoin, sharding, superminhash, tokenfiles)
from wirecorpus.llm.common import held_out, table
from wirecorpus.plans.registry import Registry
from wirecorpus.session import checkpoint_base

R = Registry()


@R.add("op1_line_rules")
def op1_line_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.judge(docs, model).drop("content_spans")


@R.add("op2_pieces")
def op2_pieces(spark, sf_dir):
    return pieces.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=False)


@R.add("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    pieces = packing.token_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(pieces, 4096)


@R.add("op4_shards")
def op4_shards(spark, sf_dir):
    return sharding.shard_by_size(table(spark, sf_dir, "documents"), 24)


@R.add("op5_language")
def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


@R.add("op6_compression")
def op6_compression(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    found = compression.score(docs, compression.fit(docs, labels))
    return found.withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "score", "predicted", "gain")


@R.add("op7_phrases")
def op7_phrases(spark, sf_dir):
    return phrases.fingerprint_edits(table(spark, sf_dir, "documents"))


@R.add("op8_licences", licences.oracle(licences.NOTICES))
def op8_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents")).drop("hits")


@R.add("op8_licence_passages")
def op8_licence_passages(spark, sf_dir):
    return licences.passages(table(spark, sf_dir, "documents")).drop("passages")


@R.add("op9_superminhash")
def op9_superminhash(spark, sf_dir):
    found = superminhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@R.add("op10_token_files")
def op10_token_files(spark, sf_dir):
    out = f"{checkpoint_base(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return tokenfiles.located(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


@R.add("op11_prefix_join")
def op11_prefix_join(spark, sf_dir):
    return prefixjoin.linked(table(spark, sf_dir, "documents"), words=5, percent=80)


@R.add("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return periodic.measure(table(spark, sf_dir, "documents"), plant=True, keep=False)


@R.add("op13_source_divergence", divergence.oracle())
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))
