"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_crc, table
from .oracles import ORACLES

#: Fixed rules of the URL contract: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4, seed=42)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), width=35)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_earlier

    return remove_earlier(table(spark, sf_dir, "documents"), width=50)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import histogram_shards

    return histogram_shards(table(spark, sf_dir, "documents"), shards=8)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows, by the Hamming distance of the sign codes, of every row whose vec_id is divisible by 100."""
    from .hamming import sign_code, top_k

    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(codes, codes.where("id % 100 = 0"), k=10)


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score

    return score(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = table(spark, sf_dir, "documents")
    held_out = doc_crc("doc_id") % 4 == 2
    return identify(docs, docs.where(~held_out), keep=["doc_id", held_out.alias("held_out")])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, repeats=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_substring": op2_substring,
    "op3_suffix": op3_suffix,
    "op4_sharding": op4_sharding,
    "op5_url_filter": op5_url_filter,
    "op6_decontamination": op6_decontamination,
    "op7_topk": op7_topk,
    "op8_hmm": op8_hmm,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
}

__all__ = ["ORACLES", "QUERIES"]
