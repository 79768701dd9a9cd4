"""A whole search request: rank, filter, page, and expand references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.operators import filters
from trawl.operators.ann import InvertedLists, NeighbourGraph
from trawl.operators.index import SearchIndex
from trawl.operators.ordering import page, top_k
from trawl.operators.rank import rank, vector, within
from trawl.operators.relations import MAX_DEPTH, attach


def ranked(index: SearchIndex, params: Mapping[str, object], k: int, lists: InvertedLists | None = None, graph: NeighbourGraph | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """The best k hits for a request's q or vec, mode, distance and weights, among the allowed (doc_id) if given.

    A vector query walks the graph if one is given, from the request's ef_search on; else it
    probes the inverted lists if it asks for ann_probes; else, or among allowed documents, it is exact.
    """
    mode = str(params.get("mode") or "bm25")
    if mode == "vector":
        vec: Sequence[float] = params.get("vec") or ()  # type: ignore[assignment]
        vec = [float(x) for x in (vec.split(",") if isinstance(vec, str) else vec)]
        probes, ef = filters.bounded("ann_probes", params.get("ann_probes")), filters.bounded("ef_search", params.get("ef_search"))
        if allowed is None and graph is not None and any(vec):
            return graph.search(vec, k, ef)
        if allowed is None and lists is not None and probes:
            return lists.search(vec, k, probes)
        return top_k(within(vector(index, vec), allowed), k)
    weights = tuple(float(params.get(n, d)) for n, d in (("w_bm25", 1.0), ("w_semantic", 1.0), ("w_lexical", 0.5)))  # type: ignore[arg-type]
    return rank(index, str(params.get("q") or ""), k, mode, filters.bounded("distance", params.get("distance")), weights, str(params.get("boost_scope") or "parity"), allowed)  # type: ignore[arg-type]


def search(index: SearchIndex, params: Mapping[str, object], filter_mode: str = "post", lists: InvertedLists | None = None, graph: NeighbourGraph | None = None, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits of the page with rank, doc_id, score and the document's columns; one row with `total`).

    With filter_mode "post", filters apply to the best from+size hits, so total counts those among
    them that pass. With "pre", only documents that pass are ranked; corpus statistics stay global.

    With include_relations "inline" or "hierarchy", hits whose documents have a column
    relation_ref (index, id) get `relation`, the document it leads to among the targets (see
    `relations.attach`), nested to max_relation_depth; `relations.groups` groups such a page.
    """
    start, size = filters.bounded("from", params.get("from")), filters.bounded("size", params.get("size"))
    docs = index.docs.withColumnRenamed(index.id_col, "doc_id") if index.id_col != "doc_id" else index.docs
    if filter_mode == "pre":
        allowed = filters.apply(docs, index.schema, params).select("doc_id")
        hits = ranked(index, params, start + size, lists, graph, allowed)
        passed = docs.join(F.broadcast(hits) if start + size <= 10_000 else hits, "doc_id")
    else:
        hits = ranked(index, params, start + size, lists, graph)
        # The hits are a bounded page (at most from + size), the documents are not.
        passed = filters.apply(docs.join(F.broadcast(hits) if start + size <= 10_000 else hits, "doc_id"), index.schema, params)
    columns = [c for c in docs.columns if c != "doc_id"]
    total = passed.agg(F.count("*").alias("total"))
    out = page(passed, start, size).select("rank", "doc_id", "score", *columns)
    if str(params.get("include_relations") or "none") in ("inline", "hierarchy") and targets is not None and "relation_ref" in columns:
        out = attach(out, targets, min(MAX_DEPTH, filters.bounded("max_relation_depth", params.get("max_relation_depth"))))
    elif "relation_ref" in columns:
        out = out.drop("relation_ref")
    return out, total
