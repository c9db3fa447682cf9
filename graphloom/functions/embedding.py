"""Embedding providers, and embedding a column with a cache that outlives the job.

A provider is a callable ``(text, dim, role="document") -> list of floats``. ``HttpProvider`` speaks the request forms of
common services (a server of one's own included) with timeouts, retries and growing pauses; ``mock_embedding`` needs none.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from graphloom.errors import GraphError
from graphloom.functions.vector import several


class EmbeddingError(GraphError):
    """A provider that gave no vector."""


@dataclass(frozen=True)
class HttpProvider:
    """``form`` is "openai" (also local servers of that form) or "gemini"."""

    url: str
    model: str
    key: str | None = field(default=None, repr=False)
    form: str = "openai"
    timeout: float = 30.0
    retries: int = 4
    pause: float = 0.2
    batch: int = 64

    def request(self, texts: list[str], dim: int, role: str) -> urllib.request.Request:
        headers = {"Content-Type": "application/json"}
        if self.form == "openai":
            url, body = f"{self.url.rstrip('/')}/embeddings", {"model": self.model, "input": texts, "dimensions": dim}
            if self.key:
                headers["Authorization"] = f"Bearer {self.key}"
        elif self.form == "gemini":
            task = "RETRIEVAL_QUERY" if role == "query" else "RETRIEVAL_DOCUMENT"
            url = f"{self.url.rstrip('/')}/models/{self.model}:batchEmbedContents"
            body = {"requests": [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}, "outputDimensionality": dim, "taskType": task} for t in texts]}
            if self.key:
                headers["x-goog-api-key"] = self.key
        else:
            raise EmbeddingError(f"unknown form {self.form}")
        return urllib.request.Request(url, json.dumps(body).encode(), headers)

    def vectors(self, answer: dict) -> list[list[float]]:
        if self.form == "openai":
            return [d["embedding"] for d in sorted(answer["data"], key=lambda d: d.get("index", 0))]
        return [e["values"] for e in answer["embeddings"]]

    def __call__(self, text: str, dim: int, role: str = "document") -> list[float]:
        return self.many([text], dim, role)[0]

    def many(self, texts: list[str], dim: int, role: str = "document") -> list[list[float]]:
        """The vectors of several texts, ``batch`` of them a request."""
        return [v for a in range(0, len(texts), self.batch) for v in self._ask(texts[a : a + self.batch], dim, role)]

    def _ask(self, texts: list[str], dim: int, role: str) -> list[list[float]]:
        last: Exception | None = None
        for attempt in range(self.retries + 1):
            if attempt:
                time.sleep(self.pause * 2 ** (attempt - 1))
            try:
                with urllib.request.urlopen(self.request(texts, dim, role), timeout=self.timeout) as r:
                    out = self.vectors(json.load(r))
                if len(out) != len(texts):
                    raise EmbeddingError(f"{len(out)} vectors for {len(texts)} texts")
                if wrong := next((len(v) for v in out if len(v) != dim), None):
                    raise EmbeddingError(f"{wrong} elements instead of {dim}")
                return [[float(x) for x in v] for v in out]
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise EmbeddingError(f"the provider said {e.code}") from None
                last = e
            except (OSError, ValueError, KeyError, IndexError) as e:
                last = e
        raise EmbeddingError(f"no vector after {self.retries + 1} tries: {last}")


def embed_cached(df: DataFrame, source: str, target: str, dim: int, provider, cache: str, model: str) -> DataFrame:
    """``df`` with ``target`` filled from ``source`` where it is null; each text is embedded once over all jobs.

    The cache is a Parquet table by (model, dim, SHA-256 of the text). Distinct texts that aren't in it are embedded and
    appended; the vectors then come by a join on the hash, so repeated texts cost nothing and no task holds a group of them.
    """
    spark = df.sparkSession
    digest = F.sha2(F.col(source), 256)
    due = df.filter(F.col(target).isNull() & F.col(source).isNotNull()).select(digest.alias("hash"), F.col(source).alias("text")).groupBy("hash").agg(F.first("text").alias("text"))
    known = _cache(spark, cache, model, dim)
    if known is not None:
        due = due.join(known, "hash", "left_anti")

    @F.arrow_udf(ArrayType(FloatType()))
    def make(texts: pa.Array) -> pa.Array:
        return pa.array(several(provider, texts.to_pylist(), dim), pa.list_(pa.float32()))

    fresh = due.select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "hash", make.asNondeterministic()("text").alias("vector"))
    fresh.write.mode("append").parquet(cache)
    made = _cache(spark, cache, model, dim).select("hash", F.col("vector").alias("_made")).dropDuplicates(["hash"])
    joined = df.withColumn("hash", F.when(F.col(target).isNull(), digest)).join(made, "hash", "left")
    return joined.withColumn(target, F.coalesce(target, "_made")).select(*df.columns)


def _cache(spark, cache: str, model: str, dim: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    t = spark.read.schema("model string, dim int, hash string, vector array<float>").parquet(cache)
    return t.filter((F.col("model") == model) & (F.col("dim") == dim)).select("hash", "vector")
