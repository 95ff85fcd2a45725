"""Embedders: the interface, one that needs no model, and their use on tables."""

from __future__ import annotations

import hashlib
import struct
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError


class Embedder(ABC):
    """What turns texts into vectors of one dimension. It is sent to the executors, so it has to be picklable."""

    @property
    @abstractmethod
    def dimension(self) -> int: ...

    @abstractmethod
    def embed(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


class HashEmbedder(Embedder):
    """Reproducible vectors from SHA-256 of the text and a counter, read as big-endian words, of unit length."""

    def __init__(self, dimension: int = 64):
        if dimension <= 0:
            raise ConfigError(f"vectors need at least one component, not {dimension}")
        self._dimension = dimension

    @property
    def dimension(self) -> int:
        return self._dimension

    def embed(self, text: str) -> list[float]:
        n = self._dimension
        digests = b"".join(hashlib.sha256(text.encode() + str(i).encode()).digest() for i in range(-(-n // 8)))
        words = np.array(struct.unpack(f">{len(digests) // 4}I", digests)[:n], np.float64)
        norm = float(np.sqrt((words * words).sum()))
        return (words / norm if norm else words).tolist()


#: Components that the models of public services give (fixed values).
KNOWN_DIMENSIONS = {
    "text-embedding-ada-002": 1536,
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "models/text-embedding-004": 768,
    "models/embedding-001": 768,
}


class ServiceEmbedder(Embedder):
    """An embedder behind a function from texts to vectors, such as a remote service; the dimension is that given, else that known of the model, else asked for once."""

    def __init__(self, call, dimension: int | None = None, model: str | None = None):
        self._call = call
        self._dimension = dimension or KNOWN_DIMENSIONS.get(model) or len(call(["dimension"])[0])

    @property
    def dimension(self) -> int:
        return self._dimension

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        vectors = self._call(list(texts))
        if any(len(v) != self._dimension for v in vectors):
            raise ConfigError(f"the embedder gave vectors of another length than {self._dimension}")
        return [list(map(float, v)) for v in vectors]


def resolve(embedder: Embedder | None, text: str | None, vector: Sequence[float] | None) -> list[float]:
    """The given vector, else that of the text."""
    if vector is not None:
        return [float(x) for x in vector]
    if embedder is None:
        raise ConfigError("give a vector, or open the store with an embedder")
    return embedder.embed(text or "")


def hash_embedding(text: Column, dimension: int = 64) -> Column:
    """What HashEmbedder gives, as an expression in double precision: no text leaves the JVM."""
    digests = [F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit(str(i))), 256) for i in range(-(-dimension // 8))]
    words = F.array(*(F.conv(F.substring(digests[k // 8], k % 8 * 8 + 1, 8), 16, 10).cast("double") for k in range(dimension)))
    # Words and norm are bound once, as arguments of lambdas, and not worked out again for each component.
    bound = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, y: s + y * y)).alias("n")))
    return F.get(F.transform(bound, lambda b: F.transform(b["w"], lambda x: x / b["n"])), F.lit(0))


def embed_table(df: DataFrame, embedder: Embedder, text: str = "text", to: str = "embedding") -> DataFrame:
    """Add the vectors of a text column, batch by batch; a null text is embedded as an empty one."""
    if to in df.columns:
        raise ConfigError(f"column exists already: {to}")
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.FloatType(), False), False)])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                vectors = embedder.embed_batch([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=schema.names)

    return df.mapInArrow(run, schema)
