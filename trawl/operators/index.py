"""The inverted index of a collection: postings, document lengths and corpus statistics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.functions.text import term_counts, term_frequency, token_count
from trawl.schema import IndexSchema
from trawl.sources.files import read_text, write_text

SKIP = 8
#: Queries of at most this many terms are counted in the documents' rows; longer ones meet the postings in a join.
WIDE_TERMS = 32
#: Bytes of text whose terms are counted at once, documents of a range of ids whose postings of a term a task holds, and ids that are broadcast at most.
LOT_BYTES, RANGE, BROADCAST_IDS = 16 << 20, 4_000_000, 4_000_000


def rows(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A small table of the driver's values, as a local relation: no Python worker is started for it."""
    kinds = {str: pa.string(), int: pa.int64(), float: pa.float64()}
    return spark.createDataFrame(pa.table({n: pa.array(v, kinds[type(v[0])] if v else pa.string()) for n, v in columns.items()}))


@dataclass
class SearchIndex:
    """A collection with a typed column per declared field and a BIGINT doc_id.

    Nothing is computed before it is asked for. An index that was saved is opened from postings
    sorted by term, which carry their documents' lengths, a vocabulary with document frequencies
    and the corpus statistics: a query then reads the row groups of its terms and no text. Without
    a saved index, a query's terms are counted in one map pass over the texts.
    """

    docs: DataFrame
    schema: IndexSchema
    id_col: str = "doc_id"
    #: (term, doc_id, tf, doc_len), (doc_id, doc_len), (term, df) and (n_docs, n_tokens) of a saved index; the last two only if nothing has changed since.
    stored_postings: DataFrame | None = None
    stored_lengths: DataFrame | None = None
    stored_terms: DataFrame | None = None
    stored_counts: tuple[int, int] | None = None

    def bag(self) -> Column:
        """All searchable text and array elements of a document as one text; without declared fields, all strings of its JSON."""
        if not self.schema.fields and "raw" in self.docs.columns:
            return text_leaves(F.col("raw"))
        names = self.schema.names("text", "array", searchable=True)
        return F.concat_ws(" ", *(F.col(n) for n in names)) if names else F.lit("")

    def lengths(self) -> DataFrame:
        """(doc_id, doc_len): tokens of every document, also of those without any."""
        if self.stored_lengths is not None:
            return self.stored_lengths
        return self.docs.select(F.col(self.id_col).alias("doc_id"), token_count(self.bag()).cast("long").alias("doc_len"))

    def measured_postings(self) -> DataFrame:
        """(term, doc_id, tf, doc_len)."""
        if self.stored_postings is not None:
            return self.stored_postings
        found = self._counted(_rows_of, "term string, doc_id long, tf long, doc_len long")
        return found if self._unique() else found.groupBy("term", "doc_id", "doc_len").agg(F.sum("tf").alias("tf")).select("term", "doc_id", "tf", "doc_len")

    def _counted(self, emit: Callable, schema: str) -> DataFrame:
        """What emit makes of the terms of each lot of documents: their ids, and the results of `term_counts`. A map pass, without a shuffle."""
        return self.docs.select(F.col(self.id_col).cast("long").alias("doc_id"), self.bag().alias("text")).mapInArrow(_by_lot(emit), schema)

    def _ids(self) -> tuple[int, int, int, int]:
        """Documents, different ids, and the least and greatest id."""
        own = F.col(self.id_col)
        return tuple(self.docs.agg(F.count("*"), F.count_distinct(own), F.coalesce(F.min(own), F.lit(0)), F.coalesce(F.max(own), F.lit(0))).first())

    def _unique(self) -> bool:
        """Whether no id repeats, so that a document's counts are its postings; else they have to meet by id."""
        n, different, *_ = self._ids()
        return n == different

    def postings(self) -> DataFrame:
        """(term, doc_id, tf)."""
        if self.stored_postings is not None:
            return self.stored_postings.select("term", "doc_id", "tf")
        found = self._counted(_rows_of, "term string, doc_id long, tf long, doc_len long").select("term", "doc_id", "tf")
        return found if self._unique() else found.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))

    def corpus(self) -> DataFrame:
        """One row: n_docs, n_tokens, avgdl (1.0 if no document has a token, as scores divide by it)."""
        if self.stored_counts is not None:
            n_docs, n_tokens = self.stored_counts
            return _averaged(self.docs.sparkSession.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(n_tokens).cast("long").alias("n_tokens")))
        return _averaged(self.lengths().agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("n_tokens")))

    def document_frequencies(self) -> DataFrame:
        """(term, df); a filter on the term reaches the saved index."""
        if self.stored_terms is not None:
            return self.stored_terms
        if not self._unique():
            return self.postings().groupBy("term").agg(F.count("*").alias("df"))
        return self._totals().filter("term is not null").select("term", "df")

    def _totals(self) -> DataFrame:
        """(term, df, n_docs, n_tokens): a row a term, and one without a term for the documents and tokens. Ids must not repeat."""
        return self._counted(_totals_of, "term string, df long, n_docs long, n_tokens long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "n_docs", "n_tokens")))

    def statistics(self) -> DataFrame:
        """One row: n_docs, n_tokens, n_terms, n_postings, in one pass over the texts."""
        if self.stored_postings is None and self._unique():
            sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_docs", "n_docs"), ("n_tokens", "n_tokens"))]
            return self._totals().agg(*sums, F.count("term").alias("n_terms"), F.sum("df").alias("n_postings"))
        terms = self.document_frequencies().agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
        return self.corpus().select("n_docs", "n_tokens").crossJoin(F.broadcast(terms))

    def matches(self, terms: dict[str, int]) -> DataFrame:
        """(term, qtf, doc_id, tf, doc_len, df) of a saved index's postings of the given terms; only their row groups are read."""
        names = list(terms)
        known = self.document_frequencies().filter(F.col("term").isin(names))
        known = known.join(F.broadcast(rows(self.docs.sparkSession, {"term": names, "qtf": list(terms.values())})), "term")
        return self.measured_postings().filter(F.col("term").isin(names)).join(F.broadcast(known), "term")  # a row a term

    def skip_pointers(self, stride: int = SKIP) -> DataFrame:
        """(term, position, doc_id): every stride-th posting of each term, for inspection."""
        n, different, least, most = self._ids() if self.stored_postings is None else (0, 1, 0, 0)
        if n != different:
            position = F.row_number().over(Window.partitionBy("term").orderBy("doc_id")) - 1
            return self.postings().select("term", position.alias("position"), "doc_id").filter(F.col("position") % stride == 0)
        # A lot's postings of a term are one row, which meet by term in order of ranges of ids.
        ranges = max(1, -(-n // RANGE))
        width = (most - least) // ranges + 1
        lots = self._counted(_lists_of(least, width), "term string, range long, ids binary")
        return lots.repartition("term").sortWithinPartitions("term", "range").mapInArrow(_strided(stride), "term string, position long, doc_id long")

    def without(self, deleted: DataFrame) -> SearchIndex:
        """The index without the documents of (doc_id)."""
        gone = deleted.select(F.col("doc_id").alias(self.id_col))
        # Only ids are held in memory: a sort-merge join would sort the texts.
        gone = F.broadcast(gone) if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
        return replace(self._less(deleted.select("doc_id")), docs=self.docs.join(gone, self.id_col, "left_anti"))

    def _less(self, gone: DataFrame) -> SearchIndex:
        parts = [None if t is None else t.join(gone, "doc_id", "left_anti") for t in (self.stored_postings, self.stored_lengths)]
        return SearchIndex(self.docs, self.schema, self.id_col, *parts)

    def refreshed(self, changed: DataFrame) -> SearchIndex:
        """A saved index after the documents of (doc_id) were added, replaced or deleted: only those that exist are read and tokenised."""
        ids = changed.select("doc_id").distinct()
        new = SearchIndex(self.docs.join(ids.select(F.col("doc_id").alias(self.id_col)), self.id_col, "left_semi"), self.schema, self.id_col)
        old = self._less(ids)
        return replace(old, stored_postings=old.stored_postings.unionByName(new.measured_postings()), stored_lengths=old.stored_lengths.unionByName(new.lengths()))

    def wide(self, terms: Iterable[str]) -> DataFrame:
        """(doc_id, doc_len, tf0, tf1, ...): how often each term occurs, in the documents that aren't indexed."""
        counted = self.docs.select(F.col(self.id_col).alias("doc_id"), self.bag().alias("_bag"))
        return counted.select("doc_id", token_count(F.col("_bag")).cast("long").alias("doc_len"), *(term_frequency(F.col("_bag"), t).cast("long").alias(f"tf{i}") for i, t in enumerate(terms)))

    def wide_statistics(self, wide: DataFrame, terms: Iterable[str]) -> DataFrame:
        """One row: n_docs, avgdl, and df0, df1, ... of the terms, in one pass."""
        frequencies = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i, _ in enumerate(terms)]
        return _averaged(wide.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("n_tokens"), *frequencies)).drop("n_tokens")

    def query_values(self) -> DataFrame:
        """(query, doc_id, hint): stored query hints of searchable query_values fields; empty queries don't count."""
        parts = [self.docs.select(F.col(self.id_col).alias("doc_id"), F.explode(F.col(n)).alias("v")).select("v.query", "doc_id", F.col("v.score").alias("hint")) for n in self.schema.names("query_values", searchable=True)]
        if not parts:
            return self.docs.select(F.lit(None).cast("string").alias("query"), F.col(self.id_col).alias("doc_id"), F.lit(0.0).alias("hint")).limit(0)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out.filter("query <> ''")

    def doc_values(self, field: str) -> DataFrame:
        """(doc_id, value) of a searchable field; several rows a document for arrays."""
        f = self.schema.fields.get(field)
        if f is None or not f.searchable:
            return self.docs.select(F.col(self.id_col).alias("doc_id"), F.lit(None).cast("string").alias("value")).limit(0)
        value = F.explode(F.col(field)) if f.kind == "array" else F.col(field)
        return self.docs.select(F.col(self.id_col).alias("doc_id"), value.alias("value")).filter("value is not null")

    def save(self, path: str) -> None:
        """Postings in order of term and document, lengths, the vocabulary and the statistics, below a path; the statistics are written last.

        A hot term's postings are spread over the range partitions of (term, doc_id); frequencies
        and counts come from the written tables.
        """
        read = self.docs.sparkSession.read
        self.measured_postings().repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths().write.mode("overwrite").parquet(f"{path}/lengths")
        terms = read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        counts = read.parquet(f"{path}/lengths").agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        write_text(self.docs.sparkSession, f"{path}/counts.json", json.dumps(list(counts)))

    def opened(self, path: str) -> SearchIndex:
        """This collection with the index that save() wrote."""
        read = self.docs.sparkSession.read
        parts = [read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "terms")]
        return SearchIndex(self.docs, self.schema, self.id_col, *parts, tuple(json.loads(read_text(self.docs.sparkSession, f"{path}/counts.json"))))


def _by_lot(emit: Callable) -> Callable:
    """Counts the terms of (doc_id, text) lot by lot, of LOT_BYTES of text or one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                limit = (ends[start - 1] if start else 0) + LOT_BYTES
                end = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
                yield from emit(ids.slice(start, end - start), *term_counts(texts.slice(start, end - start)))
                start = end

    return run


def _sent(columns: dict) -> Iterator[pa.RecordBatch]:
    table = pa.table({n: c.cast(pa.string()) if isinstance(c, pa.LargeStringArray) else c for n, c in columns.items()})
    return iter(table.to_batches(max_chunksize=1 << 17))


def _rows_of(ids: pa.Array, vocabulary: pa.Array, term: np.ndarray, row: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(term), 1 << 17):
        own = slice(i, i + (1 << 17))
        yield from _sent({"term": vocabulary.take(pa.array(term[own])), "doc_id": ids.take(pa.array(row[own])), "tf": pa.array(counts[own]), "doc_len": pa.array(sizes[row[own]])})


def _totals_of(ids: pa.Array, vocabulary: pa.Array, term: np.ndarray, row: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    nothing = np.zeros(len(vocabulary), np.int64)
    yield from _sent({"term": vocabulary, "df": pa.array(np.bincount(term, minlength=len(vocabulary)).astype(np.int64)), "n_docs": pa.array(nothing), "n_tokens": pa.array(nothing)})
    yield from _sent({"term": pa.array([None], pa.string()), "df": pa.array([None], pa.int64()), "n_docs": pa.array([len(sizes)]), "n_tokens": pa.array([int(sizes.sum())])})


def _lists_of(least: int, width: int) -> Callable:
    """A row a term and range of ids: the ids of its documents."""

    def emit(ids: pa.Array, vocabulary: pa.Array, term: np.ndarray, row: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc = ids.to_numpy()[row]
        parts = (doc - least) // width
        for part in np.unique(parts):
            t, d = term[parts == part], doc[parts == part]
            first = np.flatnonzero(np.diff(t, prepend=-1))
            ends = np.append(first, len(t)).astype(np.int64) * 8
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(d))])
            for i in range(0, len(first), 1 << 17):
                own = slice(i, i + (1 << 17))
                yield from _sent({"term": vocabulary.take(pa.array(t[first[own]])), "range": pa.array(np.full(len(first[own]), part)), "ids": blobs.slice(i, 1 << 17).cast(pa.binary())})

    return emit


def _strided(stride: int) -> Callable:
    """Of (term, range, ids) in order of term and range: every stride-th id of each term in order, with its position."""

    def positions(table: pa.Table, offset: int) -> tuple[Iterator[pa.RecordBatch], int]:
        """Of whole ranges; the first term's positions begin at the offset. The second result is how many ids the last term has had."""
        terms, ids = table.column("term").combine_chunks(), table.column("ids").combine_chunks()
        sizes = pa.compute.binary_length(ids).to_numpy() // 8
        code = terms.dictionary_encode()
        number = np.repeat(code.indices.to_numpy(), sizes)
        doc = np.frombuffer(b"".join(ids.to_pylist()), np.int64)
        order = np.lexsort((doc, number))
        number, doc = number[order], doc[order]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        place = np.arange(len(number)) - np.repeat(first, np.diff(np.append(first, len(number))))
        place[number == 0] += offset
        keep = place % stride == 0
        return _sent({"term": code.dictionary.take(pa.array(number[keep])), "position": pa.array(place[keep]), "doc_id": pa.array(doc[keep])}), int(place[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        term, had = None, 0  # the last term whose ranges were passed, and its ids so far

        def passed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal term, had
            out, count = positions(table, had if table.column("term")[0].as_py() == term else 0)
            term, had = table.column("term")[-1].as_py(), count
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            for piece in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                held.append(piece)
                table = pa.Table.from_batches(held)
                same = pa.compute.and_(pa.compute.equal(table.column("term"), table.column("term")[-1]), pa.compute.equal(table.column("range"), table.column("range")[-1]))
                whole = int(np.argmax(same.to_numpy()))  # what lies before the last term's last range is complete
                if whole:
                    yield from passed(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield from passed(pa.Table.from_batches(held))

    return run


def _averaged(total: DataFrame) -> DataFrame:
    return total.withColumn("avgdl", F.when(F.col("n_tokens") > 0, F.col("n_tokens") / F.col("n_docs")).otherwise(F.lit(1.0)))


def text_leaves(raw: Column) -> Column:
    """All string values of a JSON text at any depth, as one text: what an index without declared fields is searched by.

    Every string literal of the text is read with the colon that may follow it, so keys are told
    from values; the values' escapes are decoded by the JSON reader. What isn't JSON has none.
    """
    literals = F.filter(F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\.)*+"\s*+:?'), 0), lambda x: ~x.endswith(":"))
    values = F.from_json(F.concat(F.lit("["), F.array_join(literals, ","), F.lit("]")), "array<string>")
    return F.when(F.try_parse_json(raw).isNotNull(), F.array_join(values, " ")).otherwise("")
