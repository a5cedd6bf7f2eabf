"""Queries on the mail archive and on sketches, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import count_tokens, encode_corpus
from .mixing import mix
from .residue import find_residue
from .sketch import merge, percentiles, sketch

PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_load_states(spark: SparkSession, d: str) -> DataFrame:
    """The partial result of each load: a state per asset, load and field."""
    return merge(sketch(table(spark, d, "cotacoes"), ["asset", "load_id"], ["price", "volume"]), ["asset", "load_id"])


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of price and volume of each asset, from the combined partial results of the loads."""
    found = percentiles(merge(p1_load_states(spark, d), ["asset"]), ["asset"], PROBABILITIES)
    return found.select("asset", "field", "n", *[F.element_at("values", i + 1).alias(f"p{round(100 * p):02d}") for i, p in enumerate(PROBABILITIES)])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents")
    key = F.struct("doc_id", "source")
    sized = count_tokens(documents.select(key.alias("key"), "text"), "key").select(F.col("key.doc_id").alias("id"), F.col("key.source").alias("source"), "tokens")
    return mix(materialize(sized, "sized"), table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_residue(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents"), sender_col="from_addr")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_residue(spark, d).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_percentiles, p7_ids, p8_mixture, p8_shares, p9_found, p9_residue)}
SQL: dict[str, str] = {}
