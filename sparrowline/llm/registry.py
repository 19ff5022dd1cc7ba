"""The corpus operators as named queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from sparrowline.llm import sql
from sparrowline.llm.common import pick, read_table


def op1_chat_format(spark, sf_dir):
    from sparrowline.llm.chat_format import digests, format_chats

    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    rows = pick(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return digests(format_chats(rows.unionByName(extra)))


def op2_mixing(spark, sf_dir):
    from sparrowline.llm.mixing import mix

    found = mix(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_license_scan(spark, sf_dir):
    from sparrowline.llm.license_scan import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op4_ann(spark, sf_dir):
    from sparrowline.llm.ann import search

    return search(read_table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark, sf_dir):
    from sparrowline.llm.url_filter import judge

    return judge(read_table(spark, sf_dir, "pages"))


def op6_toxicity(spark, sf_dir):
    from sparrowline.llm.toxicity import score

    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_simhash(spark, sf_dir):
    from sparrowline.llm.simhash import clusters, hex_digits

    found = clusters(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op8_token_files(spark, sf_dir):
    import public_tokenizers

    from pyspark.sql import functions as F

    from sparrowline.llm.token_files import read, write

    files = write(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_packing(spark, sf_dir):
    from sparrowline.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op10_exact_topk(spark, sf_dir):
    from sparrowline.llm.exact_topk import search

    return search(read_table(spark, sf_dir, "embeddings"))


def op11_main_text(spark, sf_dir):
    from sparrowline.llm.main_text import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op12_centroid_clusters(spark, sf_dir):
    from sparrowline.llm.centroid_clusters import cluster

    return cluster(read_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark, sf_dir):
    from sparrowline.llm.conversation_repair import repair_damaged

    return repair_damaged(read_table(spark, sf_dir, "conversations"))


def queries():
    every = (
        op1_chat_format,
        op2_mixing,
        op3_license_scan,
        op4_ann,
        op5_url_filter,
        op6_toxicity,
        op7_simhash,
        op8_token_files,
        op9_packing,
        op10_exact_topk,
        op11_main_text,
        op12_centroid_clusters,
        op13_conversation_repair,
    )
    return {f.__name__: f for f in every}


def oracle_sql():
    return {
        "op1_chat_format": sql.CHAT_FORMAT,
        "op2_mixing": sql.MIXING,
        "op10_exact_topk": sql.EXACT_TOPK,
        "op12_centroid_clusters": sql.CLUSTERS,
        "op13_conversation_repair": sql.REPAIR,
    }
