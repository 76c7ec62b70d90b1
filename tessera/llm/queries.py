"""The opN_<name> queries of the corpus operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import chat, contamination, divergence, exact_dedup, merkle, mixing, near_dup, oracles, packing, pii, quality, secrets, token_files, toxicity
from tessera.llm.common import read


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_chat_formatting(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    return chat.format_and_verify(turns.unionByName(fixed))


def op4_token_files(spark, sf_dir):
    return token_files.write_and_read(read(spark, sf_dir, "documents"))


def op5_near_dedup(spark, sf_dir):
    return near_dup.near_components(read(spark, sf_dir, "documents"), width=2)


def op6_secret_scan(spark, sf_dir):
    found = secrets.secrets(read(spark, sf_dir, "documents"), carry=["doc_id"])
    count = lambda k: F.expr(f"CAST(size(filter(base, b -> b.kind = {k})) AS BIGINT)")
    return found.select(
        "__row.doc_id",
        *[count(k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)],
        F.sha2(F.expr(secrets.joined_spans("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(secrets.joined_spans("spans")).alias("spans"),
    )


def op7_personal_data(spark, sf_dir):
    found = pii.personal_data(read(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"CAST(size(filter(base, b -> b.kind = {k})) AS BIGINT)")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{pii.KINDS[k]}") for k in range(4)],
        F.sha2(F.expr(pii.joined_spans("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(pii.joined_spans("spans")).alias("spans"),
    )


def op8_quality_rules(spark, sf_dir):
    out = quality.judged(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mixing(spark, sf_dir):
    out = mixing.mixed(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("__row.doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark, sf_dir):
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark, sf_dir):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars")
    out = merkle.manifest(read(spark, sf_dir, "documents"), changes={"n_chars": more}, where=chosen)
    folded = F.element_at("copied", -1)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("siblings")).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op12_decontamination(spark, sf_dir):
    found = contamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op13_source_divergence(spark, sf_dir):
    return divergence.divergences(read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = (
        op1_exact_dedup, op2_packing, op3_chat_formatting, op4_token_files, op5_near_dedup,
        op6_secret_scan, op7_personal_data, op8_quality_rules, op9_mixing, op10_toxicity, op11_merkle_manifest,
        op12_decontamination, op13_source_divergence, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql():
    return dict(oracles.SQL)
