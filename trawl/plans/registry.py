"""All queries of the engine over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions.text import crc32_hex, query_terms, to_base64, tokens
from trawl.operators import ann, documents, filters, rank, relations
from trawl.operators.index import SearchIndex, rows, text_leaves
from trawl.operators.ordering import top_k
from trawl.operators.search import search
from trawl.plans import tables
from trawl.schema import IndexSchema, schema_id
from trawl.sources import changelog, snapshots

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}

#: Common table expressions of the SQL side.
INDEX_SQL = """tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+'))) AS term FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+')) AS doc_len FROM documents),
corpus AS (SELECT count(*) AS n_docs, sum(doc_len) AS n_tokens, sum(doc_len) / count(*) AS avgdl FROM lens),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
BM25_SQL = "qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / avgdl))"
K = 20


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _found.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def _q(query: str) -> str:
    return "q(term, qtf) AS (VALUES " + ", ".join(f"('{t}', {n})" for t, n in query_terms(query).items()) + ")"


def _hits_sql(query: str, score: str, every: bool, k: int | None = K, full: bool = False) -> str:
    having = f"HAVING count(*) = {len(query_terms(query))}" if every else ""
    cut = f"ORDER BY round(sum({score}), 6) DESC, doc_id LIMIT {k}" if k else ""
    value = f"sum({score})" if full else f"round(sum({score}), 6)"
    return f"SELECT doc_id, {value} AS score FROM post JOIN q USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN corpus GROUP BY doc_id {having} {cut}"


def _semantic_sql(k: int = K, full: bool = False) -> str:
    value = "sum(qtf * tf * w * w) / (sqrt(sum(tf * tf * w * w)) * (SELECT sqrt(sum(qtf * qtf * w * w)) FROM wq))"
    return f"SELECT doc_id, {value if full else f'round({value}, 6)'} AS score FROM post JOIN wq USING (term) GROUP BY doc_id ORDER BY round({value}, 6) DESC, doc_id LIMIT {k}"


_WQ = "wq AS (SELECT term, qtf, ln((n_docs - df + 0.5) / (df + 0.5) + 1) AS w FROM q JOIN df USING (term) CROSS JOIN corpus)"


# Text analysis and index construction


@register("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+')) AS n_tokens, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+'), lambda x: lower(x)))) AS n_terms FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@register(f"WITH {INDEX_SQL} SELECT term, doc_id, tf FROM post")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).postings()


@register(f"WITH {INDEX_SQL} SELECT n_docs, n_tokens::BIGINT AS n_tokens, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).corpus().withColumn("avgdl", F.round("avgdl", 6))


@register(f"WITH {INDEX_SQL} SELECT term, df FROM df")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).document_frequencies()


@register(f"WITH {INDEX_SQL}, r AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS position FROM post) SELECT term, position, doc_id FROM r WHERE position % 8 = 0")
def skip_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).skip_pointers().withColumn("position", F.col("position").cast("long"))


@register("SELECT '" + tables.HINTED + "' AS query, doc_id, CASE WHEN lang = 'fr' THEN 0.75 ELSE 0.25 END::DOUBLE AS hint FROM documents WHERE n_chars > " + str(tables.LONG))
def query_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hinted(spark, sf_dir).query_values()


@register(f"WITH {INDEX_SQL} SELECT term, doc_id, tf FROM post JOIN documents USING (doc_id) WHERE lang <> 'en'")
def postings_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tables.documents(spark, sf_dir)
    return index.without(index.docs.filter("lang = 'en'").select("doc_id")).postings()


# Ranking


@register(f"WITH {INDEX_SQL}, {_q('the of that')} {_hits_sql('the of that', 'qtf * tf', True)}")
def search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(tables.searched(spark, sf_dir), "the of that", K, "lexical")


@register(f"WITH {INDEX_SQL}, {_q('license under the')} {_hits_sql('license under the', BM25_SQL, True)}")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(tables.searched(spark, sf_dir), "license under the", K)


@register(f"WITH {INDEX_SQL}, {_q('license of Apache that')} {_hits_sql('license of Apache that', BM25_SQL, False)}")
def search_bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(tables.searched(spark, sf_dir), "license of Apache that", K, "or")


@register(f"WITH {INDEX_SQL}, {_q('the the that')} {_hits_sql('the the that', BM25_SQL, True)}")
def search_bm25_repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(tables.searched(spark, sf_dir), "the the that", K)


@register(
    f"WITH {INDEX_SQL}, q0(q, n) AS (VALUES ('license', 1), ('apache', 1)), q AS (SELECT term, sum(n) AS qtf FROM df, q0 WHERE levenshtein(term, q) <= 1 GROUP BY term ORDER BY term LIMIT 2000) "
    f"SELECT doc_id, round(sum({BM25_SQL}), 6) AS score FROM post JOIN q USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN corpus GROUP BY doc_id HAVING count(*) = (SELECT count(*) FROM q) ORDER BY score DESC, doc_id LIMIT {K}"
)
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(tables.searched(spark, sf_dir), "license apache", K, "fuzzy", distance=1)


@register(f"WITH {INDEX_SQL}, q0(q, n) AS (VALUES ('license', 1), ('general', 1)) SELECT term, sum(n)::BIGINT AS qtf FROM df, q0 WHERE levenshtein(term, q) <= 2 GROUP BY term ORDER BY term LIMIT 2000")
def fuzzy_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.expansions(tables.searched(spark, sf_dir), "license general", 2)


_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(f"SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains({_ASCII.format('''text || ' ' || coalesce(lang || ' ', '') || coalesce(source || ' ', '')''')}, 'under the mit license') ORDER BY doc_id LIMIT {K}")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tables.documents(spark, sf_dir)
    index.schema = IndexSchema.parse({"fields": {"text": "text", "lang": "text", "source": "text"}})
    return rank.rank(index, "Under the MIT License", K, "phrase")


@register(f"WITH {INDEX_SQL}, {_q('that of license')}, {_WQ} {_semantic_sql()}")
def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(tables.searched(spark, sf_dir), "that of license", K, "semantic")


@register(
    f"WITH {INDEX_SQL}, {_q('license under the')}, {_WQ}, b AS ({_hits_sql('license under the', BM25_SQL, True, 2 * K, True)}), s AS ({_semantic_sql(2 * K, True)}), l AS ({_hits_sql('license under the', 'qtf * tf', True, None)}), "
    f"u AS (SELECT doc_id, score * 0.7 AS score FROM b UNION ALL SELECT doc_id, score * 1.2 FROM s UNION ALL SELECT doc_id, score * 0.4 FROM l) SELECT doc_id, round(sum(score), 6) AS score FROM u GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {K}"
)
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(tables.searched(spark, sf_dir), "license under the", K, "hybrid", weights=(0.7, 1.2, 0.4))


@register(
    f"WITH {INDEX_SQL}, {_q(tables.HINTED)}, b AS ({_hits_sql(tables.HINTED, BM25_SQL, True, K, True)}), h AS (SELECT doc_id, 10.0::DOUBLE * CASE WHEN lang = 'fr' THEN 0.75 ELSE 0.25 END AS score FROM documents WHERE n_chars > {tables.LONG}), "
    f"u AS (SELECT * FROM b UNION ALL SELECT * FROM h) SELECT doc_id, round(sum(score), 6) AS score FROM u GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {K}"
)
def search_query_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(tables.hinted(spark, sf_dir), tables.HINTED, K)


# Filters and pages

_LABELLED = "labelled AS (SELECT d.*, l.quality, l.flag FROM documents d LEFT JOIN (SELECT doc_id, max(quality)::DOUBLE AS quality, max(toxic) = 1 AS flag FROM labels GROUP BY doc_id) l USING (doc_id))"


def _filtered_sql(condition: str, start: int = 0, size: int = 500, pre: bool = False) -> str:
    hits = _hits_sql("the of", BM25_SQL, False, None)
    need = start + size
    inner = f"SELECT * FROM ({hits}) JOIN labelled USING (doc_id) WHERE {condition} ORDER BY score DESC, doc_id LIMIT {need}" if pre else f"SELECT * FROM (SELECT * FROM ({hits}) ORDER BY score DESC, doc_id LIMIT {need}) JOIN labelled USING (doc_id) WHERE {condition}"
    return f"WITH {INDEX_SQL}, {_q('the of')}, {_LABELLED}, f AS ({inner}), r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f) SELECT rank, doc_id, score FROM r WHERE rank > {start} AND rank <= {start + size}"


def _filtered(spark: SparkSession, sf_dir: str, mode: str = "post", **params) -> DataFrame:
    hits, _ = search(tables.labelled(spark, sf_dir), {"q": "the of", "mode": "or", "size": 500} | params, mode)
    return hits.select(F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@register(_filtered_sql("source = 'src3' AND lang = 'en'"))
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filter_source="src3", filter_lang="en")


@register(_filtered_sql("quality = 1"))
def filter_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filter_quality="1")


@register(_filtered_sql("n_chars BETWEEN 1000 AND 3000"))
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, range_field="n_chars", range_min="1000", range_max="3000")


@register(_filtered_sql("n_chars >= 2000"))
def filter_number_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filter_n_chars_min="2000", filter_n_chars_max="none")


@register(_filtered_sql("flag"))
def filter_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, flag="true")


@register(_filtered_sql("lang = 'en' AND NOT flag"))
def filter_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, tag="en", filter_flag="false")


@register(_filtered_sql("quality = 1", 10, 30, pre=True))
def filter_before_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "pre", filter_quality="1", **{"from": 10, "size": 30})


@register(_filtered_sql("lang = 'en'", 20, 40))
def page_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, filter_lang="en", **{"from": 20, "size": 40})


@register(f"WITH {INDEX_SQL}, {_q('the of')}, h AS ({_hits_sql('the of', BM25_SQL, False, 60)}) SELECT count(*) AS total FROM h JOIN documents USING (doc_id) WHERE lang = 'en'")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(tables.searched(spark, sf_dir), {"q": "the of", "mode": "or", "from": 20, "size": 40, "filter_lang": "en"})[1]


# Vectors

_E = "e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings)"
_COSINE = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9), 6)"


@register(f"WITH {_E} SELECT b.doc_id, {_COSINE} AS score FROM e a, e b WHERE a.doc_id = (SELECT min(doc_id) FROM e) ORDER BY score DESC, b.doc_id LIMIT {K}")
def vector_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = tables.embeddings(spark, sf_dir)
    query = vecs.orderBy("doc_id").first()["vec"]
    return top_k(rank.vector(SearchIndex(vecs, tables.VECTORS), query), K)


@register(f"WITH {_E}, p AS (SELECT a.doc_id, b.doc_id AS neighbour, {_COSINE} AS similarity FROM e a JOIN e b ON a.doc_id <> b.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, neighbour) AS rank FROM p) SELECT * FROM r WHERE rank <= 16")
def vector_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbour_graph(tables.embeddings(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def _assigned_sql(to: str, centroids: str) -> str:
    """Each vector with the centroid of the highest product, the first of equal ones."""
    return f"{to} AS (SELECT doc_id, v, cid FROM (SELECT e.doc_id, e.v, cid, row_number() OVER (PARTITION BY e.doc_id ORDER BY round(list_dot_product(e.v, c), 9) DESC, cid) AS n FROM e, {centroids}) WHERE n = 1)"


def _means_sql(to: str, assigned: str) -> str:
    means = f"SELECT cid, list(m ORDER BY i) AS c FROM (SELECT cid, i, avg(v[i]) AS m FROM {assigned}, range(1, 65) r(i) GROUP BY cid, i) GROUP BY cid"
    return f"{to} AS (SELECT cid, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM ({means}))"


_SEEDS = "c0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS cid, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM (SELECT * FROM e ORDER BY doc_id LIMIT 8))"
_LISTS = f"{_E}, {_SEEDS}, {_assigned_sql('a1', 'c0')}, {_means_sql('c1', 'a1')}, {_assigned_sql('a2', 'c1')}, {_means_sql('c2', 'a2')}, {_assigned_sql('a3', 'c2')}"


@register(f"WITH {_LISTS} SELECT cid, n, i, round(c[i], 6) AS value FROM c2 JOIN (SELECT cid, count(*) AS n FROM a3 GROUP BY cid) USING (cid), range(1, 65) r(i)")
def vector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted lists' centroids, a row a dimension, and how many vectors each list holds."""
    lists = ann.InvertedLists.build(tables.embeddings(spark, sf_dir))
    flat = {"cid": [c for c, x in enumerate(lists.centroids) for _ in x], "i": [i + 1 for x in lists.centroids for i in range(len(x))], "value": [float(v) for x in lists.centroids for v in x]}
    sizes = lists.lists.groupBy(F.col("cid").cast("long").alias("cid")).agg(F.count("*").alias("n"))
    return rows(spark, flat).join(sizes, "cid").select("cid", "n", "i", F.round("value", 6).alias("value"))


def _lists_sql(probes: int, k: int) -> str:
    probed = f"q AS (SELECT doc_id AS query_id, v AS qv, cid FROM (SELECT e.doc_id, e.v, cid, row_number() OVER (PARTITION BY e.doc_id ORDER BY list_dot_product(e.v, c) DESC, cid) AS n FROM e, c2) WHERE n <= {probes})"
    score = "round(list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v)) + 1e-9), 6)"
    return f"WITH {_LISTS}, {probed}, s AS (SELECT query_id, doc_id, {score} AS score FROM q JOIN a3 USING (cid)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= {k}"


def _lists(spark: SparkSession, sf_dir: str, probes: int) -> DataFrame:
    vecs = tables.embeddings(spark, sf_dir)
    queries_ = vecs.select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))
    return ann.search_lists(ann.InvertedLists.build(vecs), queries_, 10, probes).withColumn("rank", F.col("rank").cast("long"))


@register(_lists_sql(ann.PROBES, 10))
def vector_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a query; two of eight lists are searched, as by default."""
    return _lists(spark, sf_dir, ann.PROBES)


#: Lists that a query must search, of eight, for a recall of 0.9: the vectors of the tables cluster little. The graph needs far fewer comparisons.
PROBES = 6


@register(
    f"WITH i AS ({_lists_sql(PROBES, 10)}), {_E}, p AS (SELECT a.doc_id AS query_id, b.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY {_COSINE} DESC, b.doc_id) AS n FROM e a JOIN e b ON a.doc_id <> b.doc_id), "
    "x AS (SELECT query_id, doc_id FROM p WHERE n <= 9), h AS (SELECT count(*) AS hits FROM x JOIN i USING (query_id, doc_id)), m AS (SELECT count(DISTINCT query_id) AS samples FROM x) SELECT hits, samples, round(hits / (samples * 9), 6) AS recall FROM h, m"
)
def vector_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = ann.neighbour_graph(tables.embeddings(spark, sf_dir), 9).select(F.col("doc_id").alias("query_id"), F.col("neighbour").alias("doc_id"))
    return ann.recall_at_k(_lists(spark, sf_dir, PROBES), exact, 9)


def _queried(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vecs = tables.embeddings(spark, sf_dir)
    return vecs, vecs.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))


@register()
def vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 100 are queries, against all; a walk over the neighbour graph, approximate."""
    vecs, queries_ = _queried(spark, sf_dir)
    return ann.search_graph(ann.NeighbourGraph.build(vecs), queries_, 10, 128)


@register()
def vector_graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs, queries_ = _queried(spark, sf_dir)
    exact = ann.exact_neighbours(queries_, vecs, 9).select("query_id", "doc_id")
    return ann.recall_at_k(vector_graph(spark, sf_dir), exact, 9)


# References and views


@register("SELECT c_custkey, c_nationkey::VARCHAR AS relation_ref, 'nation' AS target, n_nationkey::VARCHAR AS target_id, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def relation_inline_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.collections(spark, sf_dir)
    out = relations.inline(c["customer"].docs, "customer", c, 1)
    return out.select("c_custkey", "relation_ref", F.col("relation.index").alias("target"), F.col("relation.id").alias("target_id"), F.col("relation.doc.n_name").alias("n_name"))


@register("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def relation_inline_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.collections(spark, sf_dir)
    out = relations.inline(c["orders"].docs, "orders", c, 3)
    return out.select("o_orderkey", F.col("relation.doc.c_name").alias("c_name"), F.col("relation.relation.doc.n_name").alias("n_name"), F.col("relation.relation.relation.doc.r_name").alias("r_name"))


@register(
    f"WITH {INDEX_SQL}, {_q('license under the')}, h AS ({_hits_sql('license under the', BM25_SQL, True, 60)}), r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id FROM h) "
    "SELECT min(rank) AS position, source AS ref, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS children FROM r JOIN documents USING (doc_id) GROUP BY source"
)
def relation_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = search(tables.searched(spark, sf_dir), {"q": "license under the", "size": 60})
    return relations.hierarchy(hits, "source").withColumn("children", F.array_join("children", ",")).withColumn("position", F.col("position").cast("long"))


@register(
    "SELECT c_custkey, 'nation' AS ref_index, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_nationkey::VARCHAR END AS ref_id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE n_name END AS name, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE r_name END AS region "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def relation_stored_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as stored JSON has them: numbers, strings, objects with an index, and none; two levels deep."""
    t = lambda name: tables.table(spark, sf_dir, name)
    none = F.lit(None).cast("struct<index:string,id:string>")
    nation = t("nation").select(F.lit("nation").alias("index"), F.col("n_nationkey").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("ext_id"), F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("id"), F.lit("region").alias("index")).alias("up"))).alias("raw"))
    nation = nation.withColumn("relation_ref", relations.reference(F.get_json_object("raw", "$.up"), "nation"))
    region = t("region").select(F.lit("region").alias("index"), (F.col("r_regionkey") + 100).cast("long").alias("doc_id"), F.col("r_regionkey").cast("string").alias("ext_id"), F.to_json(F.struct(F.col("r_name").alias("name"))).alias("raw"), none.alias("relation_ref"))
    key, kind = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 4
    given = F.when(kind == 0, key).when(kind == 1, F.concat(F.lit('"'), key, F.lit('"'))).when(kind == 2, F.concat(F.lit('{"id": '), key, F.lit(', "index": "nation"}'))).otherwise("null")
    page = t("customer").select("c_custkey", relations.reference(given, "customer", "nation").alias("relation_ref"))
    out = relations.attach(page, nation.unionByName(region), 2)
    return out.select("c_custkey", F.lit("nation").alias("ref_index"), F.col("relation_ref.id").alias("ref_id"), F.get_json_object("relation.doc", "$.name").alias("name"), F.get_json_object("relation.relation.doc", "$.name").alias("region"))


VIEW = {
    "base_index": "orders",
    "select": ["o_orderkey", "o_totalprice"],
    "relations": [{"name": "buyer", "field": "o_custkey", "target_index": "customer", "select": ["c_name"], "relations": [{"name": "home", "field": "c_nationkey", "target_index": "nation", "select": ["n_name"]}]}],
}


@register("SELECT o_orderkey, o_totalprice, c_name AS buyer, n_name AS home FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def view_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.collections(spark, sf_dir)
    out = relations.expand(c["orders"].docs, relations.View.parse(VIEW, c), c)
    return out.select("o_orderkey", "o_totalprice", F.col("buyer.c_name").alias("buyer"), F.col("buyer.home.n_name").alias("home"))


@register("SELECT conv_id::VARCHAR AS ref, min(rank) AS position, count(*) AS n FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id, turn) AS rank FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id")
def hierarchy_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.table(spark, sf_dir, "conversations").filter("text is not null")
    from trawl.operators.ordering import global_rank

    keyed = turns.select("conv_id", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"))
    return relations.hierarchy(global_rank(keyed, "doc_id"), "conv_id").select("ref", "position", "n")


# Stored documents


@register("SELECT doc_id FROM documents WHERE source = 'src3'")
def stored_match_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.column_match(tables.table(spark, sf_dir, "documents"), "source", "src3")


@register("SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'de'")
def stored_match_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.column_match(tables.table(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source")), "tags", "de")


@register("SELECT event_id AS doc_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 26")
def stored_match_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("raw"))
    return documents.stored_match(events, "k", 26.0)


@register("SELECT p_partkey AS doc_id, p_name FROM part WHERE p_partkey = 7")
def lookup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("ext_id"), "p_name")
    return documents.lookup(part, "007").select("doc_id", "p_name")


_EVENT_SCHEMA = {"fields": {"k": "number", "event_type": "text", "user_id": "number", "value": "number"}, "doc_id": {"field": "user_id", "type": "number"}}


@register("WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT event_id AS ordinal, CASE WHEN n = 1 THEN 'accepted' ELSE 'document id exists' END AS outcome FROM e")
def bulk_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events")
    batch = events.select(F.col("event_id").alias("ordinal"), documents.merged(F.col("props"), F.to_json(F.struct("event_type", "user_id", "value"))).alias("raw"))
    good, bad = documents.bulk(batch, IndexSchema.parse(_EVENT_SCHEMA))
    return good.select("ordinal", F.lit("accepted").alias("outcome")).unionAll(bad.select("ordinal", F.col("error").alias("outcome")))


@register("""SELECT event_id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, value FROM events""")
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events")
    raw = documents.merged(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("kind"), "value")))
    v = F.parse_json(raw)
    return events.select(F.col("event_id").alias("doc_id"), *(F.variant_get(v, f"$.{n}", t).alias(n) for n, t in (("k", "bigint"), ("kind", "string"), ("value", "double"))))


@register("SELECT row_number() OVER (ORDER BY doc_id) + 7 AS new_id, doc_id AS ordinal, length(text) AS n_chars, text FROM documents WHERE text IS NOT NULL")
def bulk_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive ids after the last one given, to rows with their whole texts."""
    docs = tables.table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("ordinal"), "text")
    return documents.with_doc_ids(docs, 7).select(F.col("doc_id").alias("new_id"), "ordinal", F.length("text").cast("long").alias("n_chars"), "text")


@register("WITH r AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS chunk FROM documents) SELECT chunk, min(doc_id) AS min_id, max(doc_id) AS max_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM r GROUP BY chunk")
def snapshot_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = snapshots.chunked(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), 300)
    return chunked.groupBy("chunk").agg(F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@register("SELECT event_id AS doc_id, 'props ' || event_type || ' ' || user_id || ' é \"x\" end' AS leaves FROM events")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strings of JSON documents at any depth, decoded, without keys."""
    events = tables.table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"a, \\"b": "props", "list": [{"type" : "'), F.col("event_type"), F.lit('", "n": 5}, ["'), F.col("user_id").cast("string"), F.lit('", null, true]], "deep": {"t": "\\u00e9 \\"x\\"", "u": "end"}}'))
    return events.select(F.col("event_id").alias("doc_id"), text_leaves(body).alias("leaves"))


@register("SELECT doc_id, lang AS given, lang AS kept, doc_id % 2 = 0 AS flag FROM documents WHERE lang = 'fr' AND doc_id % 2 = 0")
def filter_stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and the flag where no field is declared for them: they are found in the stored documents."""
    raw = F.to_json(F.struct(F.array("lang", "source").alias("labels"), (F.col("doc_id") % 2 == 0).alias("flag")))
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", raw.alias("raw"))
    found = filters.apply(docs, IndexSchema.parse({"fields": {"text": "text"}}), {"label": "fr", "flag": "true"})
    return found.select("doc_id", F.col("lang").alias("given"), F.get_json_object("raw", "$.labels[0]").alias("kept"), F.get_json_object("raw", "$.flag").cast("boolean").alias("flag"))


@register(_filtered_sql("lang = 'src3' OR source = 'src3'"))
def filter_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tables.labelled(spark, sf_dir)
    index.schema = IndexSchema.parse({"fields": {"text": "text", "tags": "array"}})
    hits, _ = search(index, {"q": "the of", "mode": "or", "size": 500, "filter_tags": "src3"})
    return hits.select(F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@register(
    f"WITH {INDEX_SQL}, {_q('license under the')}, {_WQ}, ok AS (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 1000), pa AS (SELECT * FROM post WHERE doc_id IN (SELECT doc_id FROM ok)), "
    f"b AS ({_hits_sql('license under the', BM25_SQL, True, 2 * K, True).replace('FROM post', 'FROM pa')}), s AS ({_semantic_sql(2 * K, True).replace('FROM post', 'FROM pa')}), l AS ({_hits_sql('license under the', 'qtf * tf', True, None).replace('FROM post', 'FROM pa')}), "
    f"u AS (SELECT doc_id, score FROM b UNION ALL SELECT doc_id, score FROM s UNION ALL SELECT doc_id, score * 0.5 FROM l), h AS (SELECT doc_id, round(sum(score), 6) AS score FROM u GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {K}) SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM h"
)
def search_hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid among the documents that pass the filters, by the statistics of all."""
    hits, _ = search(tables.labelled(spark, sf_dir), {"q": "license under the", "mode": "hybrid", "size": K, "filter_lang": "en", "filter_n_chars_min": "1000"}, "pre")
    return hits.select(F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def _events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", changelog.DELETE).otherwise(changelog.UPSERT)
    return tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("op_id"), op.alias("op"), F.col("user_id").alias("doc_id"), F.col("props").alias("raw"))


@register("SELECT user_id AS doc_id, max(event_id) AS op_id, arg_max(props, event_id) AS raw FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def changelog_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.fold(_events_log(spark, sf_dir)).select("doc_id", "op_id", "raw")


@register("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")
    return documents.deleted(docs, labels.filter("toxic = 1")).select("doc_id", "text")


@register("SELECT doc_id, text, coalesce(l.quality, -1) AS quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(-1).alias("quality"))
    labels = tables.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return documents.upserted(docs, docs.drop("quality").join(labels, "doc_id"))


@register("WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 AS chunk FROM orders) SELECT chunk, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id, count(*) AS n FROM r GROUP BY chunk")
def snapshot_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.chunk_bounds(tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")))


@register(f"WITH {INDEX_SQL} SELECT 'documents' AS name, n_docs, n_tokens::BIGINT AS n_tokens, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM post) AS n_postings FROM corpus")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).statistics().select(F.lit("documents").alias("name"), "n_docs", "n_tokens", "n_terms", "n_postings")


@register(f"SELECT '{schema_id(_EVENT_SCHEMA)}' AS schema_id")
def schema_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = json.dumps({"schema_version": 1} | _EVENT_SCHEMA, sort_keys=True, separators=(",", ":"))
    return spark.range(1).select(crc32_hex(F.lit(body)).alias("schema_id"))


@register("SELECT doc_id, octet_length(encode(text)) AS bytes, base64(encode(text)) AS content FROM documents WHERE text IS NOT NULL")
def image_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as images: decoded and stored from JSON, then read back beside what the document says of them."""
    data = to_base64(F.encode("text", "UTF-8"))
    raw = F.to_json(F.struct(F.struct(F.lit("text").alias("format"), data.alias("content")).alias("icon")))
    docs = tables.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", raw.alias("raw"))
    kept = documents.prepared(docs, IndexSchema.parse({"fields": {"icon": {"type": "image", "max_kb": 1024}}}), F.lit(0).cast("long"))
    meta = kept.select("doc_id", F.get_json_object("raw", "$.icon.bytes").cast("long").alias("bytes"), "images")
    return documents.image_base64(meta, "icon", "bytes").select("doc_id", "bytes", "content")


@register("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def doc_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tables.documents(spark, sf_dir)
    index.schema = IndexSchema.parse({"fields": {"lang": "text", "source": "text"}})
    parts = [index.doc_values(f).groupBy(F.lit(f).alias("field"), "value").agg(F.count("*").alias("n")) for f in ("lang", "source")]
    return parts[0].unionAll(parts[1])


@register("SELECT op_id, row_number() OVER (ORDER BY op_id) AS n FROM (SELECT event_id AS op_id FROM events WHERE event_id > (SELECT max(event_id) - 50 FROM events))")
def changelog_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events_log(spark, sf_dir)
    last = log.agg(F.max("op_id")).first()[0]
    return changelog.chunk(log, last - 50, 1 << 20).select("op_id", F.row_number().over(Window.orderBy("op_id")).cast("long").alias("n"))
