"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hamming, langid, mixing, packing, phrases, quality, runs, secrets, simhash, suffix, toxicity
from .common import let, table, words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs, ~held_out)
    out = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode_documents(docs, WORD_BPE).select("doc_id", "ids")
    out = bpe.decode_documents(ids, WORD_BPE)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(r"""select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)""")
    out = chat.format_conversations(rows.unionByName(extra)).withColumn("turns", chat.parse(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, lang="lang").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.where("vec_id % 100 = 0"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    counts = [secrets.count_of(F.col("secret_spans"), k).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.shown(base), 256).alias("base_sha256"), secrets.shown(F.col("secret_spans")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out)
    out = toxicity.score_documents(docs.withColumn("held_out", held_out), model)
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")


def periodic_text(doc_id: Column, text: Column) -> Column:
    """text, whose words repeat with a period from some word on if the id's checksum is divisible by ten."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    return F.when(F.pmod(h, F.lit(10)) == 0, let(words(text), lambda w: F.when(F.size(w) > 0, again(w)))).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_text(F.col("doc_id"), F.col("text")).alias("text"))
    out = runs.periodic_runs(docs)
    first = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"], r["period"]))), 1)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = out.withColumn("best", F.when(F.size("runs") > 0, first))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_bpe, op3_simhash, op4_chat, op5_quality, op6_hamming, op7_suffix, op8_secrets, op9_packing, op10_toxicity, op11_runs, op12_mixing, op13_phrases)}

SQL = {"op4_chat": chat.SQL, "op5_quality": quality.sql(), "op6_hamming": hamming.SQL, "op8_secrets": secrets.sql(), "op12_mixing": mixing.SQL, "op13_phrases": phrases.sql()}
