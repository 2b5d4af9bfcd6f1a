"""Registered queries of the operators, each over its whole table with production parameters."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.llm import bpe, linedup, lines, manifest, merkle, minhash, mix, notices, quality, shards, spelling, suffixes, warc
from rowtide.settings import scratch_dir

#: Name of the tokenizer file; its folder is that of the installed ``public_tokenizers``.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; digests of both."""
    path = tokenizer_path()
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path)
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into archives and read back."""
    path = scratch_dir(spark, "archives")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines and sentences that stand earlier, and where they were."""
    return lines.without_repeats(_table(spark, sf_dir, "documents"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings of 100 bytes that start earlier."""
    found = suffixes.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the lines of every text that equal, or nearly equal, an earlier line."""
    return linedup.marked(_table(spark, sf_dir, "documents"), linedup.BY_LENGTH).withColumn("n_removed", F.size("removed").cast("long"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, posterior probability of being good, and the verdict per document."""
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shards.assigned(_table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes: its size for each shard that draws it."""
    plan = mix.drawn(_table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are."""
    return merkle.compare_with_next(_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, and which document of each stays."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with the frequent word that each is a spelling variant of."""
    return spelling.group(spelling.count_words(_table(spark, sf_dir, "documents")))


def op12_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every text, with the places of the notices."""
    return notices.scan(_table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document in the manifest of all."""
    return manifest.verified(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_lines": op3_lines,
    "op4_suffixes": op4_suffixes,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_shards": op7_shards,
    "op8_mix": op8_mix,
    "op9_merkle": op9_merkle,
    "op10_minhash": op10_minhash,
    "op11_spelling": op11_spelling,
    "op12_notices": op12_notices,
    "op13_manifest": op13_manifest,
}
