"""Model services behind small interfaces, called batch by batch from Arrow partitions.

A client is any object with the method named below; it is built once in each worker by
the factory that is passed in, so it needs no pickling.  The offline clients make every
plan run, and give repeatable results, without a service.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class HashEmbedder:
    """Unit vectors from hashed words: texts that share words are near."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).tolist()


class OverlapReranker:
    """Share of the query's words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(t.lower().split())) / max(1, len(wanted)) for t in texts]


class ServiceError(RuntimeError):
    """A service's refusal; ``status`` is the HTTP status, 0 if it was not reached."""

    def __init__(self, status: int, message: str):
        super().__init__(f"{status}: {message}")
        self.status = status


class HttpClient:
    """A model service over HTTP with JSON: embeddings, scores, answers and health.

    Calls that fail for want of the service are tried ``attempts`` times; a request that
    the service refuses (status 4xx, as 422 for a text beyond its limit) is not repeated.
    """

    def __init__(self, url: str, timeout: float = 60.0, attempts: int = 3, wait: float = 1.0):
        self.url, self.timeout, self.attempts, self.wait = url.rstrip("/"), timeout, attempts, wait

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.url}{path}", data, {"Content-Type": "application/json"})
        for attempt in range(1, self.attempts + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                    return json.loads(answer.read() or b"{}")
            except urllib.error.HTTPError as refused:
                if refused.code < 500 or attempt == self.attempts:
                    raise ServiceError(refused.code, refused.read().decode(errors="replace")[:500]) from refused
            except OSError as lost:
                if attempt == self.attempts:
                    raise ServiceError(0, str(lost)) from lost
            time.sleep(self.wait * attempt)
        raise ServiceError(0, "no attempt was made")

    def healthy(self) -> bool:
        try:
            return self._call("/health").get("status") in ("ok", "healthy", None)
        except ServiceError:
            return False

    def embed(self, texts: list[str]) -> list[list[float]]:
        vectors = self._call("/embed", {"texts": texts}).get("embeddings")
        if not isinstance(vectors, list) or len(vectors) != len(texts):
            raise ServiceError(200, "as many embeddings as texts are needed")
        return vectors

    def score(self, query: str, texts: list[str]) -> list[float]:
        return placed_scores(self._call("/rerank", {"query": query, "documents": texts, "top_k": len(texts)}).get("results"), len(texts))

    def generate(self, prompt: str) -> str:
        return str(self._call("/generate", {"prompt": prompt}).get("text", ""))


def placed_scores(results: list[dict] | None, count: int) -> list[float]:
    """Scores by place from a reranking service's ``(index, score)`` list.  A missing, repeated or impossible index is an error; places not named get the least number."""
    out = [float("-inf")] * count
    seen: set[int] = set()
    for item in results or []:
        if "index" not in item:
            raise ValueError("a result has no index")
        at = int(item["index"])
        if not 0 <= at < count or at in seen:
            raise ValueError(f"index {at} is not one of {count} places, or comes twice")
        seen.add(at)
        out[at] = float(item["score"])
    return out


def _batched(df: DataFrame, columns: list[str], schema: StructType, factory: Callable[[], object], call, size: int) -> DataFrame:
    """Columns kept, plus what ``call(client, *columns)`` gives for slices of at most ``size`` rows; a failure is a row's null and error, not the job's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        client = factory()
        kind = to_arrow_type(schema[-2].dataType)
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                try:
                    values, error = call(client, *(c.to_pylist() for c in part.columns[1:])), None
                except Exception as problem:  # noqa: BLE001
                    values, error = [None] * part.num_rows, f"{type(problem).__name__}: {problem}"
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, kind), pa.array([error] * part.num_rows, pa.string())], names=schema.names)

    return df.select(*columns).mapInArrow(run, schema)


def embed(df: DataFrame, key: str, text: str, factory: Callable[[], Embedder] = HashEmbedder, size: int = 64) -> DataFrame:
    """``(key, vector, error)`` of every row; a null text counts as empty."""
    schema = StructType([df.schema[key], StructField("vector", ArrayType(FloatType())), StructField("error", StringType())])
    return _batched(df, [key, text], schema, factory, lambda c, texts: c.embed([t or "" for t in texts]), size)


def score(df: DataFrame, key: str, query: str, text: str, factory: Callable[[], Reranker] = OverlapReranker, size: int = 32) -> DataFrame:
    """``(key, score, error)`` of every pair of query and text."""
    schema = StructType([df.schema[key], StructField("score", DoubleType()), StructField("error", StringType())])

    def call(client, queries, texts):
        return [client.score(q or "", [t or ""])[0] for q, t in zip(queries, texts)]

    return _batched(df, [key, query, text], schema, factory, call, size)


def generate(df: DataFrame, key: str, prompt: str, factory: Callable[[], Generator], size: int = 8) -> DataFrame:
    """``(key, answer, error)`` of every prompt."""
    schema = StructType([df.schema[key], StructField("answer", StringType()), StructField("error", StringType())])
    return _batched(df, [key, prompt], schema, factory, lambda c, prompts: [c.generate(p or "") for p in prompts], size)
