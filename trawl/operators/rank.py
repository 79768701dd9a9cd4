"""Ranking: every ranker maps an index and a query to hits (doc_id, score)."""

from __future__ import annotations

import math
import warnings
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import vectors
from trawl.functions.text import ascii_lower, query_terms, tokens
from trawl.operators.index import WIDE_TERMS, SearchIndex, rows
from trawl.operators.ordering import best, top_k

K1, B = 1.5, 0.75
#: Vocabulary terms that a fuzzy query is expanded to, at most, in order of the terms.
EXPANSIONS = 2000
BOOST = 10.0


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(tf: Column, df: Column, doc_len: Column, n_docs: Column, avgdl: Column) -> Column:
    return idf(n_docs, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avgdl))


def no_hits(index: SearchIndex) -> DataFrame:
    return index.docs.select(F.col(index.id_col).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)


def _total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _with_corpus(matched: DataFrame, index: SearchIndex) -> DataFrame:
    """Adds n_docs and avgdl: one row, known without a job if the index was saved and hasn't changed."""
    return matched.crossJoin(F.broadcast(index.corpus().select("n_docs", "avgdl")))


def _scored(index: SearchIndex, terms: Counter, every: bool, weight: Callable[[Column, Column, Column], Column], statistics: bool = True) -> DataFrame:
    """Sum over the terms of weight(tf, qtf, df); with `every`, for documents that have all of them.

    A saved index is read at the terms' postings. Otherwise up to WIDE_TERMS terms are counted in
    each document's row, in one pass without a shuffle, and the statistics are one broadcast row;
    more terms are looked up among the documents' tokens before these are counted.
    """
    if not terms:
        return no_hits(index)
    names = list(terms)
    if index.stored_postings is None and len(names) <= WIDE_TERMS:
        wide = index.wide(names)
        has = [F.col(f"tf{i}") > 0 for i in range(len(names))]
        hit = has[0]
        for h in has[1:]:
            hit = (hit & h) if every else (hit | h)
        matched = wide.filter(hit)
        if statistics:
            matched = matched.crossJoin(F.broadcast(index.wide_statistics(wide, names)))
        parts = [F.when(F.col(f"tf{i}") > 0, weight(F.col(f"tf{i}"), F.lit(terms[t]), F.col(f"df{i}"))).otherwise(0.0) for i, t in enumerate(names)]
        return matched.select("doc_id", _total(parts).cast("double").alias("score"))
    own = index.matches(terms) if index.stored_postings is not None else _found(index, terms)
    if statistics:
        own = _with_corpus(own, index)
    if len(names) == 1:
        return own.select("doc_id", weight(F.col("tf"), F.col("qtf"), F.col("df")).cast("double").alias("score"))
    scored = own.groupBy("doc_id").agg(F.sum(weight(F.col("tf"), F.col("qtf"), F.col("df"))).cast("double").alias("score"), F.count("*").alias("_n"))
    return (scored.filter(F.col("_n") == len(names)) if every else scored).select("doc_id", "score")


def _found(index: SearchIndex, terms: Counter) -> DataFrame:
    """matches() of documents without a saved index: only tokens that are terms of the query are counted."""
    q = rows(index.docs.sparkSession, {"term": list(terms), "qtf": list(terms.values())})
    each = index.docs.select(F.col(index.id_col).alias("doc_id"), tokens(index.bag()).alias("_t")).select("doc_id", F.size("_t").cast("long").alias("doc_len"), F.explode("_t").alias("term"))
    own = each.join(F.broadcast(q), "term").groupBy("term", "qtf", "doc_id", "doc_len").agg(F.count("*").alias("tf"))
    return own.join(F.broadcast(own.groupBy("term").agg(F.count("*").alias("df"))), "term")  # a row a term of the query


def lexical(index: SearchIndex, query: str) -> DataFrame:
    """Documents with all terms; the score is the sum of their frequencies, each as often as the query has the term."""
    return _scored(index, query_terms(query), True, lambda tf, qtf, df: tf * qtf, statistics=False)


def bm25_terms(index: SearchIndex, terms: Counter, every: bool = True) -> DataFrame:
    return _scored(index, terms, every, lambda tf, qtf, df: bm25_weight(tf, df, F.col("doc_len"), F.col("n_docs"), F.col("avgdl")) * qtf)


def bm25(index: SearchIndex, query: str) -> DataFrame:
    """BM25 over documents with all terms."""
    return bm25_terms(index, query_terms(query))


def bm25_or(index: SearchIndex, query: str) -> DataFrame:
    """BM25 over documents with any term."""
    return bm25_terms(index, query_terms(query), every=False)


def expansions(index: SearchIndex, query: str, distance: int = 1, most: int = EXPANSIONS) -> DataFrame:
    """(term, qtf): vocabulary terms within the edit distance of a query term, and of how many query tokens.

    A saved index has its vocabulary as a table. Otherwise the distance is tested on each token
    before any shuffle, and only what passes is made distinct.
    """
    terms = query_terms(query)
    q = rows(index.docs.sparkSession, {"q": list(terms), "qtf": list(terms.values())}) if terms else rows(index.docs.sparkSession, {"q": [""], "qtf": [0]}).limit(0)
    vocabulary = index.document_frequencies().select("term") if index.stored_postings is not None else index.docs.select(F.explode(F.array_distinct(tokens(index.bag()))).alias("term"))
    near = (F.abs(F.length("term") - F.length("q")) <= distance) & (F.levenshtein("term", "q", distance) >= 0)
    pairs = vocabulary.crossJoin(F.broadcast(q)).filter(near).distinct()  # q has a row a term of the query
    return pairs.groupBy("term").agg(F.sum("qtf").alias("qtf")).orderBy("term").limit(most)


def fuzzy(index: SearchIndex, query: str, distance: int = 1) -> DataFrame:
    """BM25 over documents with all terms that the query's terms expand to; a term near two of them counts twice.

    Of more than EXPANSIONS terms the first by name count, and a warning says so.
    """
    found = expansions(index, query, distance, EXPANSIONS + 1).collect()  # a bounded number of terms
    if len(found) > EXPANSIONS:
        warnings.warn(f"the fuzzy query expands to more than {EXPANSIONS} terms; the first of them count", stacklevel=2)
    return bm25_terms(index, Counter({r["term"]: r["qtf"] for r in found[:EXPANSIONS]}))


def phrase(index: SearchIndex, query: str) -> DataFrame:
    """Documents in whose text and array fields, each followed by a space, the query occurs, without regard to ASCII case; score 1."""
    names = index.schema.names("text", "array")
    if not query_terms(query) or not names:
        return no_hits(index)
    values = [F.array(F.col(n)) if index.schema.fields[n].kind == "text" else F.col(n) for n in names]
    parts = [F.concat_ws("", F.transform(v, lambda x: F.concat(x, F.lit(" ")))) for v in values]
    needle = "".join(c.lower() if c.isascii() else c for c in query)
    return index.docs.filter(F.contains(ascii_lower(F.concat(*parts)), F.lit(needle))).select(F.col(index.id_col).alias("doc_id"), F.lit(1.0).alias("score"))


def semantic(index: SearchIndex, query: str) -> DataFrame:
    """Cosine of tf-idf vectors over the query's terms that the index has."""
    terms = query_terms(query)
    if not terms:
        return no_hits(index)
    if index.stored_postings is not None:
        w, n_docs = idf(F.col("n_docs"), F.col("df")), _with_corpus(index.matches(terms), index)
        own = n_docs.groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("qtf") * w * w).alias("_dot"), F.sum(F.pow(F.col("tf") * w, 2)).alias("_own"))
        known = index.document_frequencies().filter(F.col("term").isin(list(terms))).join(F.broadcast(rows(index.docs.sparkSession, {"term": list(terms), "qtf": list(terms.values())})), "term")
        norm = _with_corpus(known, index).agg(F.sum(F.pow(w * F.col("qtf"), 2)).alias("_query"))  # one row
        return own.crossJoin(F.broadcast(norm)).select("doc_id", (F.col("_dot") / (F.sqrt("_own") * F.sqrt("_query"))).alias("score"))
    names = list(terms)
    wide = index.wide(names)
    hit = F.greatest(*(F.col(f"tf{i}") for i in range(len(names))), F.lit(0)) > 0
    scored = wide.filter(hit).crossJoin(F.broadcast(index.wide_statistics(wide, names)))
    weight = [F.when(F.col(f"df{i}") > 0, idf(F.col("n_docs"), F.col(f"df{i}"))).otherwise(0.0) for i in range(len(names))]
    dot = _total([F.col(f"tf{i}") * terms[t] * weight[i] * weight[i] for i, t in enumerate(names)])
    own = _total([F.pow(F.col(f"tf{i}") * weight[i], 2) for i, _ in enumerate(names)])
    query_norm = _total([F.pow(weight[i] * terms[t], 2) for i, t in enumerate(names)])
    return scored.select("doc_id", (dot / (F.sqrt(own) * F.sqrt(query_norm))).alias("score"))


def blend(parts: Sequence[DataFrame]) -> DataFrame:
    """Sum of the scores of several hit lists."""
    out = parts[0].select("doc_id", "score")
    for p in parts[1:]:
        out = out.unionAll(p.select("doc_id", "score"))
    return out.groupBy("doc_id").agg(F.sum("score").alias("score"))


def within(hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """The hits among the allowed (doc_id), or all."""
    return hits if allowed is None else hits.join(allowed.select("doc_id"), "doc_id", "left_semi")


def hybrid(index: SearchIndex, query: str, k: int, w_bm25: float = 1.0, w_semantic: float = 1.0, w_lexical: float = 0.5, allowed: DataFrame | None = None) -> DataFrame:
    """Weighted sum of raw BM25 (best 2k), tf-idf cosine (best 2k) and lexical scores."""
    arms = [(best(within(bm25(index, query), allowed), 2 * k), w_bm25), (best(within(semantic(index, query), allowed), 2 * k), w_semantic), (within(lexical(index, query), allowed), w_lexical)]
    return blend([hits.select("doc_id", (F.col("score") * w).alias("score")) for hits, w in arms])


def vector(index: SearchIndex, query: Sequence[float]) -> DataFrame:
    """Cosine to the query vector; nothing if the lengths differ, the query is zero or there is no vector field."""
    f = index.schema.vector
    if f is None or (f.dim and len(query) != f.dim) or not any(query):
        return no_hits(index)
    usable = index.docs.filter(F.size(F.col(f.name)) >= len(query))
    own = F.slice(F.col(f.name), 1, len(query))
    return usable.select(F.col(index.id_col).alias("doc_id"), vectors.cosine(own, query).alias("score"))


def boost(hits: DataFrame, index: SearchIndex, query: str, allowed: DataFrame | None = None) -> DataFrame:
    """Adds ten times the score of query hints that equal the whole query; their documents join the hits with a base of 0."""
    if not query_terms(query):
        return hits
    hinted = index.query_values().filter(F.col("query") == query).groupBy("doc_id").agg((BOOST * F.sum("hint")).alias("score"))
    return blend([hits, within(hinted, allowed)])


MODES = {"lexical": lexical, "bm25": bm25, "or": bm25_or, "bm25_or": bm25_or, "fuzzy": fuzzy, "phrase": phrase, "semantic": semantic, "tfidf": semantic}


def rank(index: SearchIndex, query: str, k: int, mode: str = "bm25", distance: int = 1, weights: tuple[float, float, float] = (1.0, 1.0, 0.5), boost_scope: str = "parity", allowed: DataFrame | None = None) -> DataFrame:
    """The best k hits of a text query. Unknown modes are bm25, and a query without a token finds nothing.

    Hints are added after the cut to k, so that a hinted document outside it starts from 0
    (boost_scope "parity"); with "full" it keeps its score. Hybrid isn't cut before. With
    `allowed` (doc_id), only those documents are ranked, by the statistics of all.
    """
    if not query_terms(query):
        return no_hits(index)
    hinted = bool(index.schema.names("query_values", searchable=True))
    if mode == "hybrid":
        hits = hybrid(index, query, k, *weights, allowed)
        return top_k(boost(hits, index, query, allowed) if hinted else hits, k)
    ranker = MODES.get(mode, bm25)
    hits = within(ranker(index, query, distance) if ranker is fuzzy else ranker(index, query), allowed)
    if not hinted:
        return top_k(hits, k)
    return top_k(boost(best(hits, k) if boost_scope == "parity" else hits, index, query, allowed), k)


def unit(values: Sequence[float]) -> list[float]:
    n = math.sqrt(sum(v * v for v in values))
    return [v / n for v in values] if n else list(values)
