"""The corpus pipeline: language, near-duplicates, benchmark leaks, source mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import attach, plain_names, row_hash, table, written
from sylvan.llm.decontaminate import contamination
from sylvan.llm.langid import identify
from sylvan.llm.mixing import mix
from sylvan.llm.sharding import histogram_shards
from sylvan.llm.simhash import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learned language explains, with the language that was inferred.

    Null texts and texts without a letter go, and so do texts that the mixture of all learned languages explains no better than
    trigrams drawn evenly. A lang that is in the inferred set of languages stays; any other, and null, becomes the language with
    the largest proportion. Without a row that has a text and a lang all rows go. Repeated rows stay, an empty table stays empty,
    and other columns, whatever their names, pass as they are.
    """
    rows, c = plain_names(docs)
    named = identify(rows, rows, text=c["text"], lang=c["lang"], keep=list(c.values()), gain=True).where("lang_pred <> 'und' and gain > 0")
    fits = F.coalesce(F.array_contains("languages", F.col(c["lang"])), F.lit(False))
    return named.withColumn(c["lang"], F.when(fits, F.col(c["lang"])).otherwise(F.col("lang_pred"))).select(*c.values()).toDF(*c)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by pairs that share 0.8 or more of their five-word shingles: the one with the smallest doc_id.

    SimHash makes the links that its blocks reach; an exact check adds those of the pairs that differ in more bits. Null, empty and
    blank texts are one group; null ids come last; of rows with one id the one with the least hash stays, and of wholly equal rows
    one. An empty table stays empty, and other columns, whatever their names, pass as they are.
    """
    return one_of_each(docs, distance=3, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, the few words that benchmark windows hit are cut out. Clean texts stay as they are.

    Null and wordless texts are clean. Repeated rows are judged alike, an empty table of either kind leaves docs as they are, and
    other columns, whatever their names, pass as they are; n_chars follows a text that was cut.
    """
    rows, c = plain_names(docs)
    judged = contamination(rows, table(spark, sf_dir, "benchmark"), text=c["text"], keep=list(c.values()), clean=True).where("not contaminated")
    cut = F.col("n_hit") > 0
    changed = {c["text"]: F.when(cut, F.col("clean_text")).otherwise(F.col(c["text"])), c["n_chars"]: F.when(cut, F.length("clean_text")).otherwise(F.col(c["n_chars"])).cast("bigint")}
    return judged.withColumns(changed).select(*c.values()).toDF(*c)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 whole copies, the one cut in part being rounded.

    Null and blank texts have no words and go. A null source is a source of its own, the last. Equal rows count together and
    their copies are divided among them. An empty table stays empty, and other columns, whatever their names, pass as they are.
    """
    rows, c = plain_names(docs)
    named = rows.withColumn("__hash", row_hash(rows))
    taken = mix(named, doc_id=c["doc_id"], text=c["text"], source=c["source"], keep=[c["doc_id"], "__hash"])
    taken = taken.select(F.col(c["doc_id"]).alias("__id"), "__hash", F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int").alias("copies"))
    decided = taken.groupBy("__id", "__hash").agg(F.sum("copies").cast("int").alias("__copies"), F.count(F.lit(1)).alias("__rows")).where("__copies > 0")
    found = attach(rows, decided, c["doc_id"], "__copies")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*c.values()).toDF(*c)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, one of 8 of nearly equal bytes, and its slot there.

    Null texts count as empty, null ids sort first, repeated rows take a slot each, and an empty table stays empty. A column of docs
    that has the name of a made one (size, text_crc32, law, shard, slot, grown_shard) gets a trailing underscore, or several.
    """
    rows, c = plain_names(docs)
    made = histogram_shards(rows, doc_id=c["doc_id"], text=c["text"], shards=8, keep=list(c.values()))
    fresh, known, kept = made.columns[len(c) :], {x.lower() for x in docs.columns}, []
    for name in docs.columns:
        new = name
        while new.lower() in fresh or (new != name and new.lower() in known):
            new += "_"
        kept.append(new)
    return made.toDF(*kept, *fresh)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL can't express the language mixture; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
