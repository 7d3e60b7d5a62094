"""Vector expressions: hash and token embeddings, unit length, cosine distance."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import let


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def unit_vector(vector: Column) -> Column:
    """Scale to length one; the zero vector stays zero."""
    return let(
        vector.cast("array<double>"),
        lambda v: let(
            _length(v),
            lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v),
        ),
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos of two unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.lit(1.0) - F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def hash_embedding(text: Column, dim: int = 16) -> Column:
    """Unit vector from the SHA-256 bytes of a text: same text, same vector."""

    def from_digest(digest: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double")
            / 255.0
            * 2.0
            - 1.0,
        )

    return unit_vector(let(F.sha2(text, 256), from_digest))


@lru_cache(1 << 18)
def _digest_place(token: str) -> int:
    """The first 16 bits of the token's SHA-256; a worker hashes a token once."""
    return int.from_bytes(hashlib.sha256(token.encode()).digest()[:2], "big")


def token_embedding(text: Column, dim: int = 64) -> Column:
    """Unit vector of token counts, each token hashed to one of ``dim`` places.

    The default encoder of the layer: no fitting step, and claims that share their words are near each
    other. Texts are split by the JVM and counted in Arrow batches, in one pass over the tokens.
    """

    @F.arrow_udf("array<double>")
    def counted(texts: pa.Array) -> pa.Array:
        n = len(texts)
        words = pc.split_pattern(texts.fill_null("").cast(pa.string()), " ")
        codes = words.flatten().dictionary_encode()
        # An empty token lies beyond the last place and is cut off.
        places = np.array([_digest_place(t) % dim if t else dim for t in codes.dictionary.to_pylist()], np.int64)
        rows = pc.list_parent_indices(words).to_numpy()
        placed = rows * (dim + 1) + places[codes.indices.to_numpy()]
        counts = np.bincount(placed, minlength=n * (dim + 1)).reshape(n, dim + 1)[:, :dim].astype(float)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = counts / np.where(length > 0, length, 1.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim), pa.int32()), pa.array(unit.ravel()))

    return F.when(text.isNotNull(), counted(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")))


def text_embedding(texts: DataFrame, text: str, out: str = "embedding", dim: int = 256) -> DataFrame:
    """TF-IDF vectors of unit length by the Spark ML feature stages (IDF needs one fitting pass)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
    ]
    model = Pipeline(stages=stages).fit(texts)
    vectors = model.transform(texts).withColumn(out, vector_to_array("_unit"))
    return vectors.drop("_words", "_counts", "_weights", "_unit")


def encode_with(texts: DataFrame, text: str, encoder, out: str = "embedding") -> DataFrame:
    """Vectors from the caller's ``encoder(list[str]) -> list[list[float]]``, one call per batch."""
    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in vector] for vector in encoder(batch.tolist())])

    return texts.withColumn(out, run(text))
