"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import ann, bpe, chat, curriculum, decontam, divergence, jaccard, langid, linededup, pii, quality, warc, whitening
from sheaf.llm.common import table
from sheaf.llm.sql import SQL  # noqa: F401  (registered beside the queries)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of each document, and whether it stays."""
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), path="lang", keep=["doc_id"])
    return judged.select("doc_id", F.col("judged.quality").alias("quality"), F.col("judged.toxic").alias("toxic"), F.col("judged.keep").alias("keep"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text encoded, and decoded from the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with surrogates for personal data. The key is the session's `spark.sheaf.surrogateKey`, or made for this run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.sheaf.surrogateKey", None) or secrets.token_hex(32)
    return pii.pseudonymise(docs, key, counted="n_entities").select("doc_id", "text", "n_entities")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, looked up by their keys and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder, _, shards = warc.archive(spark, pages)
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    found = warc.resolve(keys, shards, f"{folder}/index")
    return warc.fetch(found, f"{folder}/archives", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without its site's boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs, dropped="n_dropped").select("doc_id", "text", "n_dropped")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    network = langid.fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), langid.predict(docs, network).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and their digests read back from that."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    stored = rows.select(F.col("conv_id").alias("key"), F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    said = r"\### Assistant: </turn> ok"
    extra = json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    records = stored.unionByName(spark.range(1).select(F.lit(-7).cast("long").alias("key"), F.lit(extra).alias("record")))
    formatted = chat.format_turns(chat.canonical_turns(records))
    back = chat.read_back(formatted)
    learned = F.array_join("learned", "")
    return back.select(
        F.col("key").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


def op8_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digests(decontam.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of each document; rows without a text stand alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard.join(docs).select(F.col("id").alias("doc_id"), F.col("group").alias("class_id"), F.col("links").alias("n_links"), "copy_of")
    alone = docs.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_of"))
    return found.unionByName(alone)


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and where in the mix it stands first."""
    mixed = curriculum.per_document(curriculum.mix(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_offset")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between sources of a language, and the terms that tell each source."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of each vector."""
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_bpe, op3_pii_surrogates, op4_warc, op5_line_dedup, op6_language_id, op7_chat_format, op8_hilbert_ann, op9_decontaminate, op10_jaccard_join, op11_mix, op12_divergence, op13_whitening)}
