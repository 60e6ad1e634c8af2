"""Encoding of a stream of documents, and running segment counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codec import encoder
from ..operators.presegment import segments
from ..operators.tokenizer import Tokenizer


def encode_stream(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """Adds token_ids; stateless, so it runs in append mode with any sink."""
    return docs.withColumn("token_ids", encoder(docs.sparkSession, tokenizer)(F.col(text)))


def count_stream(docs: DataFrame, text: str = "text", weight: int = 1000) -> DataFrame:
    """Weighted segment counts so far; for update or complete mode."""
    return segments(docs, text=text).groupBy("segment").agg(F.sum(F.lit(weight).cast("long")).alias("freq"))
