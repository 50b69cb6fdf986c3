"""The registered queries: each operator over its whole table, reduced to the columns asked for."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from frameprobe.llm import (
    audit, chat, mixing, neighbours, packing, periodic, quality, repeats, secrets, simhash, topk, toxicity, warc)
from frameprobe.llm.tables import short_batches
from frameprobe.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "rate", "copies", "taken")


@query
def op3_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    records = warc.resolved(warc.read_archive(spark, path, with_payload=False))
    return records.select(
        warc.page_of("id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", warc.page_of("refers")).alias("refers_to"))


@query
def op7_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)

    def number(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    return secrets.secrets(docs).select(
        "doc_id", number(0), number(1), number(2),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["class"]), ",").alias("classes"),
        *[F.size(F.filter(spans, lambda s: s["class"] == name)).cast("long").alias(f"n_{name}") for name in ("live", "example")])


@query
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judged(docs).select("doc_id", *quality.COUNTS, "removed_words", "base_failed", "kept")


@query
def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op5_repeats(spark, sf_dir):
    found = repeats.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels"))


@query
def op4_chat(spark, sf_dir):
    calls, results = chat.turns_as_calls(table(spark, sf_dir, "conversations"))
    return chat.linked(calls, results, chat.REPLY)


@query
def op4_turns(spark, sf_dir):
    return chat.every_turn(table(spark, sf_dir, "conversations"))


@query
def op13_filters(spark, sf_dir):
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one document of ten, by the CRC-32 of its id, the words from one on repeat a block."""
    def run(batches):
        for batch in batches:
            texts = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = zlib.crc32(str(doc_id).encode())
                words = (text or "").encode().split() if doc_id is not None and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    block = words[a:a + p]
                    text = b" ".join(words[:a] + (block * (1 + (n - a) // p))[:n - a]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.schema)


@query
def op12_runs(spark, sf_dir):
    found = periodic.periodic_runs(_planted(table(spark, sf_dir, "documents")))
    runs = F.col("runs")
    best = F.try_element_at(F.array_sort(F.transform(
        runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    length = -best["shorter"]
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"),
        best["period"].alias("period"), F.call_function("div", 1000 * length, best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
