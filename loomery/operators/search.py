"""Full-text and vector search, scoping and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.functions import vectors as V

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(term, id, tf, dl): how often each word occurs in a row's fields, and the row's words in all."""
    w = F.split(F.lower(F.concat_ws(" ", *fields)), T.NO_WORD)
    rows = docs.select(F.col(id_col).alias("id"), w.alias("w"), _words_in(w).alias("dl"))
    return rows.select("id", "dl", F.explode("w").alias("term")).filter("term <> ''").groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def _words_in(split: Column) -> Column:
    # a split gives an empty word at its ends only
    return (F.size(split) - (F.element_at(split, 1) == "").cast("int") - ((F.size(split) > 1) & (F.element_at(split, -1) == "")).cast("int")).cast("long")


def word_count(fields: Sequence[str]) -> Column:
    """Words in a row's fields, as ``postings`` counts them."""
    return _words_in(F.split(F.lower(F.concat_ws(" ", *fields)), T.NO_WORD))


def bm25(docs: DataFrame, query: str, id_col: str = "id", fields: Sequence[str] = ("preview", "docstring", "symbol_name")) -> DataFrame:
    """(id, score) of rows that have a word with one of the query's prefixes; needs no index: one scan counts, one scores.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; each prefix is a phrase of its own.
    """
    prefixes = [p.lower() for p in T.query_terms(query)]
    if not prefixes:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    w = T.words(F.concat_ws(" ", *fields))
    counted = docs.select(F.col(id_col).alias("id"), w.alias("w")).select("id", F.size("w").cast("double").alias("dl"), *(F.size(_starting("w", p)).cast("double").alias(f"tf{i}") for i, p in enumerate(prefixes)))
    totals = counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *_matching(len(prefixes)))
    return _scored(counted, totals, len(prefixes))


def _matching(k: int) -> list[Column]:
    return [F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"n{i}") for i in range(k)]


def _scored(counted: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(id, score) from (id, dl, tf0 ...) and one row (n, avgdl, n0 ...), which meets every row."""
    both = counted.join(F.broadcast(totals))
    score: Column = F.lit(0.0)
    for i in range(k):
        tf, n = F.col(f"tf{i}"), F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    met = F.col("tf0") > 0
    for i in range(1, k):
        met = met | (F.col(f"tf{i}") > 0)
    return both.filter(met).select("id", score.alias("score"))


def _starting(words: str, prefix: str) -> Column:
    return F.filter(words, lambda x: x.startswith(prefix))


def bm25_of(rows: DataFrame, prefixes: Sequence[str], n_docs: int, avgdl: float) -> DataFrame:
    """The same scores from postings (term, id, tf, dl) of terms with these prefixes: only they are shuffled."""
    tf = [F.sum(F.when(F.col("term").startswith(p), F.col("tf")).otherwise(0)).cast("double").alias(f"tf{i}") for i, p in enumerate(prefixes)]
    counted = rows.groupBy("id").agg(F.first("dl").cast("double").alias("dl"), *tf)
    totals = counted.agg(F.lit(float(n_docs)).alias("n"), F.lit(float(avgdl)).alias("avgdl"), *_matching(len(prefixes)))
    return _scored(counted, totals, len(prefixes))


def ts_rank(rows: DataFrame, prefixes: Sequence[str], weight: float = 0.1, most: int = 255) -> DataFrame:
    """(id, score) by the database's rank for a disjunction of prefixes, from postings of terms that have one.

    Every word with a prefix adds weight / k^2 for its k-th place in a row, over 1.64493406685 and the number of prefixes.
    """
    places = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("tf", F.lit(most).cast("long"))), F.lit(0.0), lambda a, k: a + 1.0 / (k * k))
    met: Column = F.lit(0)
    for p in prefixes:
        met = met + F.col("term").startswith(p).cast("int")
    return rows.groupBy("id").agg((F.sum(places * met) * weight / 1.64493406685 / len(prefixes)).alias("score"))


def top(df: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows, ties by key."""
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def ranked(df: DataFrame, score: str = "score", key: str = "id", out: str = "rank", base: int = 1) -> DataFrame:
    """Rank within an already cut result."""
    return df.withColumn(out, (F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))) - 1 + base).cast("long"))


def knn(vectors: DataFrame, query: Sequence[float], k: int, keep: Column | None = None, prefilter: bool = True, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, distance, similarity) of the k nearest by L2; rows of another dimension don't count.

    ``keep`` filters before the cut, or after it where ``prefilter`` is off.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.filter(F.size(col) == len(query))
    if keep is not None and prefilter:
        rows = rows.filter(keep)
    near = rows.withColumn("distance", V.l2(F.col(col), q)).orderBy("distance", id_col).limit(k)
    if keep is not None and not prefilter:
        near = near.filter(keep)
    return near.withColumn("similarity", V.similarity(F.col("distance")))


def exact_multiplier(symbol: Column, query: str) -> Column:
    """3.0 where symbol and query are one name."""
    return F.when(T.normalise_identifier(symbol) == T.normalise_identifier_text(query), 3.0).otherwise(1.0)


def normalised_rank(rank: Column) -> Column:
    return 1.0 / (1.0 + F.abs(rank))


def scoped(df: DataFrame, kinds: Sequence[str] = (), languages: Sequence[str] = (), least: float | None = None) -> DataFrame:
    """Kind, language and score filters; an empty list is no filter."""
    if kinds:
        df = df.filter(F.col("kind").isin(*kinds))
    if languages:
        df = df.filter(F.col("language").isin(*languages))
    return df if least is None else df.filter(F.col("score") >= least)


def resolve_repo(repos: DataFrame, name: str) -> DataFrame:
    """The repository of exactly this name, else the only one that ends in /name; none if several do."""
    exact = F.col("name") == name
    found = repos.filter(exact | F.col("name").endswith("/" + name)).withColumn("_e", exact.cast("int"))
    # two numbers of the few rows that match
    most = found.agg(F.max("_e").alias("_x"), F.count_if(F.col("_e") == 1).alias("_n1"), F.count("*").alias("_n0"))
    one = F.when(F.col("_x") == 1, F.col("_n1")).otherwise(F.col("_n0")) == 1
    return found.join(F.broadcast(most)).filter((F.col("_e") == F.col("_x")) & one).drop("_e", "_x", "_n1", "_n0")


def is_test(path: Column, kind: Column) -> Column:
    """Test code by path or kind; in patterns _ stands for any character, and case doesn't count."""
    # fixed values: path patterns of test code
    patterns = ("%/test/%", "%/tests/%", "%/__tests__/%", "%.test.ts%", "%.test.js%", "%.test.tsx%", "%.test.jsx%", "%.spec.ts%", "%.spec.js%", "%_test.rs%", "%_test.py%")
    out = kind.ilike("%test%")
    for p in patterns:
        out = out | path.ilike(p)
    return out


def neighbours(df: DataFrame, group: str, order: Sequence[str], id_col: str, n: int) -> DataFrame:
    """(id, neighbour, position): up to n rows before and after each row of its group."""
    w = Window.partitionBy(group).orderBy(*order)
    numbered = df.select(group, id_col, F.row_number().over(w).alias("rn"))
    spread = numbered.select(group, F.col(id_col).alias("id"), "rn", F.explode(F.array(*(F.lit(k) for k in range(-n, n + 1) if k))).alias("position"))
    other = numbered.select(F.col(group).alias("_g"), F.col(id_col).alias("neighbour"), F.col("rn").alias("_rn"))
    return spread.join(other, (spread[group] == other["_g"]) & (spread["rn"] + spread["position"] == other["_rn"])).select("id", "neighbour", F.col("position").cast("long").alias("position"))


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
