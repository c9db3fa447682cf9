"""Text predicates and lexical ranking as Spark expressions.

Tokens are runs of Unicode letters and digits, with ASCII letters in lower case (other letters stand as they are).
"""

from __future__ import annotations

import string

import regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of BM25.
K1, B = 1.2, 0.75
_TOKEN = r"[\p{IsAlphabetic}\p{N}]+"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def tokens(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(_TOKEN), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """The tokens of a constant, on the driver."""
    return regex.findall(r"[\p{Alphabetic}\p{N}]+", text.translate(_LOWER))


def _array(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def query(value) -> Column:
    """Tokens of a query: a constant string, or a column."""
    return tokens(value) if isinstance(value, Column) else _array(query_tokens(value))


def search(text: Column, q) -> Column:
    """Every query token is a token of the text."""
    need, have = query(q), tokens(text)
    return F.coalesce((F.size(need) > 0) & (F.size(F.array_except(need, have)) == 0), F.lit(False))


def match_text(text: Column, q) -> Column:
    """The query's tokens stand in the text in a row. Joined with blanks around, that is a substring test."""
    need, have = query(q), tokens(text)
    joined = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.coalesce((F.size(need) > 0) & F.contains(joined(have), joined(need)), F.lit(False))


def fuzzy(text: Column, q, max_edits: int | None = None) -> Column:
    """Each query token is near a token of the text: by default 0 edits up to 2 letters, 1 up to 5, else 2."""
    if max_edits is not None and max_edits < 0:
        raise ValueError("max_edits must not be negative")
    need, have = query(q), tokens(text)

    def near(n: Column) -> Column:
        size = F.char_length(n)
        if max_edits is not None:
            return F.exists(have, lambda t: F.levenshtein(t, n, max_edits) >= 0)
        return F.when(size <= 2, F.array_contains(have, n)).when(size <= 5, F.exists(have, lambda t: F.levenshtein(t, n, 1) >= 0)).otherwise(F.exists(have, lambda t: F.levenshtein(t, n, 2) >= 0))

    return F.coalesce((F.size(need) > 0) & F.forall(need, near), F.lit(False))


def bm25(df: DataFrame, text: Column, q: str, out: str) -> DataFrame:
    """``df`` with the BM25 score of ``text`` for a constant query; the rows of ``df`` are the corpus.

    One aggregate gives the number of texts, their average length and each query term's document frequency; its one row
    is broadcast. Null texts aren't counted and score 0.
    """
    counts: dict[str, int] = {}
    for t in query_tokens(q):
        counts[t] = counts.get(t, 0) + 1
    terms = sorted(counts)
    if not terms:
        return df.withColumn(out, F.lit(0.0))
    # Length and term frequencies are a projection of their own, so that a text is cut into tokens once.
    t = F.col("_tokens")
    counted = df.withColumn("_tokens", tokens(text)).withColumns({"_dl": F.size(t)} | {f"_tf{i}": F.size(t) - F.size(F.array_remove(t, w)) for i, w in enumerate(terms)})
    stats = counted.filter(text.isNotNull()).agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *[F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    stats = stats.select(F.struct("*").alias("_bm25"))
    # The aggregate has one row, whatever the input.
    scored = counted.withColumn("_null", text.isNull()).drop("_tokens").join(F.broadcast(stats))
    s = F.col("_bm25")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.when(s["avgdl"] > 0, F.col("_dl").cast("double") / s["avgdl"]).otherwise(0.0))
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        tf, freq = F.col(f"_tf{i}").cast("double"), s[f"df{i}"].cast("double")
        idf = F.log(1 + (s["n"] - freq + 0.5) / (freq + 0.5))
        score = score + F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + norm) * counts[w]).otherwise(0.0)
    return scored.withColumn(out, F.when(F.col("_null"), 0.0).otherwise(score)).drop("_bm25", "_dl", "_null", *[f"_tf{i}" for i in range(len(terms))])
