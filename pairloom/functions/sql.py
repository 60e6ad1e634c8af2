"""SQL functions: bpe_encode, bpe_decode, bpe_presegments (table function), bpe_sequence_digest, and the artifact source."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.codec import Coder, _coder
from ..operators.tokenizer import Tokenizer
from ..sources.artifacts import ArtifactSource


def register(spark: SparkSession, tokenizer: Tokenizer) -> None:
    name, sent = tokenizer.digest, spark.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("array<int>")
    def bpe_encode(text: pd.Series) -> pd.Series:
        coder: Coder = _coder(name, sent)
        return pd.Series([None if t is None else coder.encode(t.encode("utf-8", "surrogatepass")) for t in text])

    @F.pandas_udf("binary")
    def bpe_decode(ids: pd.Series) -> pd.Series:
        coder: Coder = _coder(name, sent)
        return pd.Series([None if x is None else coder.decode([int(i) for i in x]) for x in ids])

    @F.udtf(returnType="seg_no int, segment string")
    class bpe_presegments:
        def eval(self, line: str):
            import re

            for i, s in enumerate(re.findall("[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+", line or "")):
                yield i, s

    @F.pandas_udf("string")
    def bpe_sequence_digest(ordinal: pd.Series, a: pd.Series, b: pd.Series, merged: pd.Series) -> str:
        rows = sorted(zip(ordinal, a, b, merged))
        return hashlib.sha256(b"".join(struct.pack("<III", *map(int, r[1:])) for r in rows)).hexdigest().upper()

    spark.udf.register("bpe_encode", bpe_encode)
    spark.udf.register("bpe_decode", bpe_decode)
    spark.udf.register("bpe_sequence_digest", bpe_sequence_digest)
    spark.udtf.register("bpe_presegments", bpe_presegments)
    spark.dataSource.register(ArtifactSource)
