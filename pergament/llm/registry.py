"""Queries of the training-data operators with production parameters, and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from pergament.llm import bpe, chunk_dedup, fill_middle, filter_audit, license_scan, minhash, mixing, quality, rans, sharding, simhash, url_filter, warc_zstd


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file of this box; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, freq = rans.write_archive(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1)
    return rans.read_archive(spark, manifest, freq)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.read(spark, warc_zstd.write(pages(spark, sf_dir)))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup(documents(spark, sf_dir)).drop("row")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), 40)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(pages(spark, sf_dir)).drop("block_probability")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.exact_links(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("row", "copies")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(documents(spark, sf_dir)).drop("failed_rule")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.cluster(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(documents(spark, sf_dir))


def queries() -> dict:
    own = [op1_rans, op2_license_scan, op3_warc_zstd, op4_chunk_dedup, op5_bpe, op6_sharding, op7_url_filter, op8_simhash, op9_mixing, op10_quality, op11_minhash, op12_filter_audit, op13_fill_middle]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    modules = {"op2_license_scan": license_scan, "op4_chunk_dedup": chunk_dedup, "op10_quality": quality, "op12_filter_audit": filter_audit, "op13_fill_middle": fill_middle}
    return {name: module.oracle() for name, module in modules.items()}
