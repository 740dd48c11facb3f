"""The registered queries over the given tables and their SQL; ``QUERIES`` and ``SQL`` are added by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import ann, bagminhash, bpe, chat, egojoin, merkle, mixing, periodic, rans, recompression, tokencount, warc, weaklabel
from codeloom.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_mixing(spark, sf_dir):
    """doc_id, size, source_size, target, taken of every document."""
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


SQL["op5_mixing"] = mixing.SQL


@query
def op6_chat(spark, sf_dir):
    """Every conversation formatted, and digests of what is read back from the formatted text."""
    said = F.lit("</s>[INST] ok [/INST]")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    messages = written(chat.linear(rows), "chat-messages")
    done = chat.formatted(chat.paths(messages))
    conv_id = F.split("root", ":")[0]
    told = done.withColumn("turns", chat.read_turns(F.col("text"))).withColumn(
        "loss", chat.masked_text(F.col("text"), F.col("loss_mask")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return told.select(
        F.when(conv_id != "null", conv_id.cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


SQL["op6_chat"] = chat.SQL


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_bpe(spark, sf_dir):
    """Digests of the ids of every text, and of the text that the ids decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


@query
def op7_rans(spark, sf_dir):
    """Every text's ids written as entropy-coded files, and where each document lies and its checksum, read back from them."""
    files = rans.write(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)
    return rans.read(files).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_quality(spark, sf_dir):
    """Every document with its weak label, its score and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return weaklabel.scored(docs, weaklabel.fit(docs)).select("doc_id", "score", "keep")


@query
def op1_warc(spark, sf_dir):
    """Every page as a WARC record, written as monolithic archives, normalised, and read back by the offset index."""
    folder = warc.write_monolithic(table(spark, sf_dir, "pages"))
    return warc.read(warc.normalise(spark, folder))


SQL["op1_warc"] = warc.SQL


@query
def op3_ann(spark, sf_dir):
    """The 20 nearest vectors, by inner product, of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op4_ego_join(spark, sf_dir):
    """Links, component and kept vector of every vector, by cosine within its label."""
    return egojoin.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op4_ego_join"] = egojoin.SQL


@query
def op9_bagminhash(spark, sf_dir):
    """Every document with the id of its group of near-duplicates, and whether it is the one that stays."""
    return bagminhash.labelled(table(spark, sf_dir, "documents"))


SQL["op9_bagminhash"] = bagminhash.SQL


@query
def op8_substring_dedup(spark, sf_dir):
    """How many words every document loses to repeated windows, and the digest of what is kept."""
    return recompression.digests(table(spark, sf_dir, "documents"))


SQL["op8_substring_dedup"] = recompression.SQL


@query
def op12_token_counts(spark, sf_dir):
    """The tokens of every whole text, as the last of the counts of its prefixes."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = tokencount.total(F.col("counts"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          n_tokens.alias("n_tokens"), (n_tokens > 1024).alias("over_limit"))


@query
def op13_periodic_runs(spark, sf_dir):
    """The runs of every text, after about one in ten has got a periodic tail, and digests of them and of the collapsed texts."""
    return periodic.digests(periodic.planted(table(spark, sf_dir, "documents")))


@query
def op11_merkle(spark, sf_dir):
    """Every document's leaf, tree root, proof and its verification, after one in seven has been tampered with."""
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


SQL["op11_merkle"] = merkle.SQL
