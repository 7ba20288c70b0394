"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, media, minhash, mixing, quality, ring, substrings, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int, held: int) -> Callable[[Column], Column]:
    """True for doc_ids whose checksum, modulo ``parts``, is ``held``; nulls are held out."""
    return lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == held, F.lit(True))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.MinHash(shingle=4, percent=80))


@_query
def op2_ring(spark, sf_dir):
    return ring.assign(_table(spark, sf_dir, "documents"), ring.Ring(shards=40))


@_query
def op3_urls(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"), urls.RULES)


ORACLES["op3_urls"] = urls.ORACLE_SQL


@_query
def op4_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


@_query
def op5_tokens(spark, sf_dir):
    return tokens.encode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@_query
def op6_quality(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(3, 1))


@_query
def op7_toxicity(spark, sf_dir):
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(5, 0))


@_query
def op8_substrings(spark, sf_dir):
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), substrings.Repeats(length=35))


@_query
def op9_media(spark, sf_dir):
    return media.round_trip(_table(spark, sf_dir, "documents"))


@_query
def op10_decontamination(spark, sf_dir):
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
