"""The registered queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vacancia.llm import avi, ballkmeans, bpe, bytebpe, covertree, extract, langid, licenses, packing, quotes, simhash, toxicity, whitening
from vacancia.llm.common import table

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digest(avi.store(table(spark, sf_dir, "documents")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op9_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(bytebpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op12_ballkmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ballkmeans.integer_vectors(table(spark, sf_dir, "embeddings"))
    return ballkmeans.digests(*ballkmeans.cluster(vectors, ballkmeans.starts(vectors)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


_OPERATORS = (op1_quotes, op2_packing, op3_avi, op4_licenses, op5_toxicity, op6_simhash, op7_langid, op8_extract, op9_covertree, op10_bpe, op11_bytebpe, op12_ballkmeans, op13_whitening)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES: dict[str, str] = {"op4_licenses": licenses.ORACLE_SQL, "op12_ballkmeans": ballkmeans.ORACLE_SQL}
