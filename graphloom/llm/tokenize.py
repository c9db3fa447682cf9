"""Encoding of a whole corpus with a public tokenizer.

A vectorised Arrow UDF cuts texts into words and merges each distinct word once (see ``bpe``); the ids of a chunk of
texts are gathered at once. There is no shuffle but for inputs of fewer files than cores; the vocabulary (a file of fixed
size) is broadcast.

Defined results: null, and the empty text, give an empty list; markers of special tokens are ordinary text; every row
comes out once, repeated rows as often as they are there; further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from graphloom.llm import bpe
from graphloom.util import over_cores


def share(spark, vocab: str):
    return spark.sparkContext.broadcast(bpe.read_vocab(vocab))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", *, vocab: str = bpe.DEFAULT_VOCAB) -> DataFrame:
    """``docs`` with the token ids of ``text``."""
    shared = share(docs.sparkSession, vocab)

    @F.arrow_udf(ArrayType(IntegerType()))
    def to_ids(texts: pa.Array) -> pa.Array:
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for chunk in bpe.held(shared).chunks(texts.to_pylist()):
            offsets, own = chunk.ids()
            parts.append(own)
            sizes.append(np.diff(offsets))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(parts)))

    return over_cores(docs).withColumn(ids, to_ids(text))


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", *, vocab: str = bpe.DEFAULT_VOCAB) -> DataFrame:
    """``docs`` with the text of their token ids."""
    shared = share(docs.sparkSession, vocab)

    @F.arrow_udf(StringType())
    def to_text(x: pa.Array) -> pa.Array:
        b = bpe.held(shared)
        return pa.array([None if i is None else b.decode(i) for i in x.to_pylist()], pa.string())

    return docs.withColumn(text, to_text(ids))
