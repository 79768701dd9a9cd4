"""Licences of files: TF-IDF cosine of headers and licence files to templates, inherited along directories."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrowtext import PUNCT, parts, pieces, trimmed
from trawl.llm.exchange import release, stored, tuned
from trawl.llm.licence_texts import TEXTS

#: Bags of words of the notices by which licences are applied or named; order doesn't matter to a cosine.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("license licensed mit released the under", "spdx license identifier mit", "mit license", "associated charge copies copyright deal documentation files free granted hereby is limitation merge modify notice obtaining of permission permit person persons publish restriction sell software sublicense the to use whom without",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    "Apache-2.0": ("2 0 apache license licensed the under version", "spdx license identifier apache 2 0", "apache license version 2 0", "2 0 a agreed an and any apache apache applicable as at basis by compliance conditions copy distributed either except express file governing implied in is kind language law license license licenses limitations may not obtain of on or org permissions required software specific the this to under unless use version warranties with without writing www you"),
    "GPL-3.0": ("3 general gnu is license licensed public the this under version work", "spdx license identifier gpl 3 0 or later only", "gnu general public license version 3", "gplv3", "3 any as by can distributed either foundation free general gnu hope in it later license modify of option program public published redistribute software terms that the this under useful version will without warranty"),
    "GPL-2.0": ("2 general gnu is license licensed public the this under version work", "spdx license identifier gpl 2 0 or later only", "gnu general public license version 2", "gplv2"),
    "LGPL-3.0": ("3 general gnu lesser license licensed public the under version", "spdx license identifier lgpl 3 0 or later only", "gnu lesser general public license version 3"),
    "LGPL-2.1": ("1 2 general gnu lesser license licensed public the under version", "spdx license identifier lgpl 2 1 or later only", "gnu lesser general public license version 2 1"),
    "AGPL-3.0": ("3 affero general gnu license licensed public the under version", "spdx license identifier agpl 3 0 or later only", "gnu affero general public license version 3"),
    "BSD-3-Clause": ("3 bsd clause license licensed the under", "spdx license identifier bsd 3 clause", "binary conditions contributors derived endorse forms from modification names neither nor permitted products promote provided redistribution source that used with without written prior permission"),
    "BSD-2-Clause": ("2 bsd clause license licensed the under", "spdx license identifier bsd 2 clause", "simplified bsd license"),
    "MPL-2.0": ("0 2 license mozilla of public subject terms the to", "spdx license identifier mpl 2 0", "0 2 code copy distributed file form if is license mozilla mpl not obtain of one org public source subject terms the this to v was with you"),
    "ISC": ("isc license licensed released the under", "spdx license identifier isc", "above all and any appear copies copyright distribute fee for granted hereby in is modify notice or permission provided purpose software that the this to use with without"),
    "CC-BY-4.0": ("4 0 by cc licensed under", "attribution commons creative international 4 0 license licensed under a", "spdx license identifier cc by 4 0"),
    "CC-BY-SA-4.0": ("4 0 by cc licensed sa under", "attribution commons creative international sharealike share alike 4 0 license licensed under a", "spdx license identifier cc by sa 4 0"),
    "CC-BY-NC-4.0": ("4 0 by cc licensed nc under", "attribution commons creative international noncommercial non commercial 4 0 license licensed under a", "spdx license identifier cc by nc 4 0"),
    "CC-BY-ND-4.0": ("4 0 by cc licensed nd under", "attribution commons creative international noderivatives no derivatives 4 0 license licensed under a", "spdx license identifier cc by nd 4 0"),
    "CC0-1.0": ("1 0 cc0 dedicated licensed public domain under universal", "spdx license identifier cc0 1 0", "commons creative zero public domain dedication"),
    "Unlicense": ("unlicense released the under", "spdx license identifier unlicense", "domain encumbered free into is public released software this unencumbered"),
    "Proprietary": ("all reserved rights", "all reserved rights copyright c", "confidential proprietary and all rights reserved"),
}
#: A line can only be a notice if one of these occurs in it; all templates have one.
HINT = r"licen[cs]|copyright|copying|spdx|rights reserved|creative commons|public domain|cc0|\bcc[- ]by|gplv|redistribut|permission"
#: Least cosine of a notice to a template.
SIMILARITY = 0.75
#: Texts of at least so many words are also compared, as a whole, with whole licence texts.
LEAST_TEXT = 60
#: Least cosine of a whole text to a licence's: texts share many common words.
WHOLE_SIMILARITY = 0.85
#: Whole texts that are made of their notices.
MADE = {"MIT": ("mit license copyright c", *TEMPLATES["MIT"][3:]), "ISC": ("isc license copyright c", TEMPLATES["ISC"][2])}
#: A text more than this share of whose words are in notices of its licence is a licence file.
FILE_SHARE = 0.5
#: File names of licence files.
FILE_NAME = r"(?i)(^|/)(licen[cs]es?|copying|unlicense|notice)([-._][^/]*)?$"

#: Words outside the templates whose frequencies take at most this many bytes are shipped to every task, others joined by text.
BROADCAST_BYTES = 32 << 20

_HINT = re.compile(HINT, re.I)


def _words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for i, j, p in pieces(pa.array(texts, pa.string()), PUNCT, lower=True):
        out += np.split(p.hashes, np.cumsum(p.counts)[:-1]) if j > i else []
    return out


def _bag(text: str) -> np.ndarray:
    """Hashes of the words of a text given with counts, each as often as it occurs."""
    pairs = [(w.partition(":")[0], int(w.partition(":")[2] or 1)) for w in text.split(" ")]
    return np.repeat(np.concatenate(_words([w for w, _ in pairs])), [n for _, n in pairs])


@dataclass
class Matcher:
    """Templates as sparse unit vectors over their words, with weights from a corpus: notices first, whole texts after them."""

    names: list[str]
    vocabulary: np.ndarray
    idf: np.ndarray
    rare: float
    vectors: np.ndarray
    n_notices: int
    #: Words outside the templates that occur in notices, ascending, and their weights.
    other: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    other_idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n_docs: int = 0

    @staticmethod
    def build(n_docs: int, frequency: dict[int, int]) -> Matcher:
        pairs = [(name, t) for name, ts in TEMPLATES.items() for t in ts]
        bags = _words([t for _, t in pairs]) + [_bag(t) for t in TEXTS.values()] + _words([" ".join(ts) for ts in MADE.values()])
        vocabulary = np.unique(np.concatenate(bags))
        df = np.array([frequency.get(int(w.view(np.int64)), 0) for w in vocabulary], dtype=np.float64)
        idf = np.log((n_docs + 1) / (df + 1)) + 1
        vectors = np.zeros((len(bags), len(vocabulary)))
        for k, bag in enumerate(bags):
            np.add.at(vectors[k], np.searchsorted(vocabulary, bag), 1)
        vectors *= idf
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        return Matcher([n for n, _ in pairs] + [*TEXTS, *MADE], vocabulary, idf, float(np.log(n_docs + 1) + 1), vectors, len(pairs), n_docs=n_docs)

    def knowing(self, words: np.ndarray, df: np.ndarray) -> Matcher:
        """The same with the document frequencies of words outside the templates."""
        order = np.argsort(words)
        return replace(self, other=words[order], other_idf=np.log((self.n_docs + 1) / (df[order] + 1)) + 1)

    def unknown(self, words: np.ndarray) -> np.ndarray:
        """Different words outside the templates."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.unique(words[self.vocabulary[at] != words])

    def match(self, words: np.ndarray, weight: float | None = None, whole: bool = False) -> tuple[float, str]:
        """Highest cosine and its licence, to notices or to whole texts; words outside the templates have the given weight, their own, or that of words no document has."""
        if not len(words):
            return 0.0, ""
        rows = slice(self.n_notices, None) if whole else slice(0, self.n_notices)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words
        x = np.bincount(at[known], minlength=len(self.vocabulary)) * self.idf
        others, other = np.unique(words[~known], return_counts=True)
        if weight is not None:
            other = other * weight
        elif len(self.other):
            at = np.minimum(np.searchsorted(self.other, others), len(self.other) - 1)
            other = other * np.where(self.other[at] == others, self.other_idf[at], self.rare)
        else:
            other = other * self.rare
        norm = np.sqrt((x**2).sum() + (other**2).sum())
        # Few of a notice's words are in the vocabulary, so the product takes only their columns.
        has = np.flatnonzero(x)
        names = self.names[rows]
        cosine = np.round(self.vectors[rows][:, has] @ x[has] / norm, 6) if norm else np.zeros(len(names))
        best = cosine.max()
        return float(best), min(n for n, c in zip(names, cosine) if c == best)


def _frequencies(vocabulary: np.ndarray):
    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(len(vocabulary), dtype=np.int64), np.zeros(len(vocabulary), dtype=bool)
        for batch in batches:
            for _, _, p, _, whole in parts(batch.column(0), PUNCT, lower=True):
                at = np.minimum(np.searchsorted(vocabulary, p.hashes), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[at] == p.hashes)
                if not whole or held.any():  # a part of a long text: its words count once
                    held[at[known]] = True
                    if whole:
                        total += held
                        held[:] = False
                    continue
                cell = np.unique(p.rows[known] * len(vocabulary) + at[known])
                total += np.bincount(cell % len(vocabulary), minlength=len(vocabulary))
        has = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[has].view(np.int64)), pa.array(total[has])], names=["word", "n"])

    return count


def fit(docs: DataFrame, text: str = "text") -> Matcher:
    """Counts in how many of all documents each word of the templates occurs."""
    vocabulary = Matcher.build(0, {}).vocabulary
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(_frequencies(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a word of the templates
    return Matcher.build(docs.count(), {r["word"]: r["n"] for r in rows})


@trimmed
def _all_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, p in pieces(batch.column(0), PUNCT, lower=True):
            order = np.lexsort((p.rows, p.hashes))
            words, rows = p.hashes[order], p.rows[order]
            new = np.concatenate([[True], (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])]) if len(words) else np.zeros(0, bool)
            words, n = np.unique(words[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def _wanted(shared, similarity: float):
    """Words outside the templates in notices and texts that could reach the similarity, by the text that has them."""

    @trimmed
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # The least weight of a word, one, gives the highest cosine a notice can have.
                own = [matcher.unknown(words) for words in _words([t for *_, t in _notices(text)]) if matcher.match(words, 1.0)[0] >= similarity]
                words = _words([text])[0]
                if len(words) >= LEAST_TEXT and matcher.match(words, 1.0, True)[0] >= WHOLE_SIMILARITY:
                    own.append(matcher.unknown(words))
                own = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
                keys.append(np.full(len(own), key))
                found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["key", "word"])

    return wanted


def _notices(text: str) -> list[tuple[int, int, str]]:
    """(line, end line, text) of what may be a notice: every line with a hint, every two neighbours, and every block of lines around one."""
    lines = text.split("\n")
    hits = [i for i, x in enumerate(lines) if _HINT.search(x)]
    out, done = [], -1
    for i in hits:
        out.append((i, i + 1, lines[i]))
        if i + 1 < len(lines) and lines[i + 1].strip():
            out.append((i, i + 2, lines[i] + " " + lines[i + 1]))
        if i <= done:
            continue
        a = b = i
        while a > 0 and lines[a - 1].strip():
            a -= 1
        while b + 1 < len(lines) and lines[b + 1].strip():
            b += 1
        done = b
        if b > a:
            out.append((a, b + 1, " ".join(lines[a : b + 1])))
    return out


def _scan(shared, similarity: float, file_share: float):
    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        general = shared.value
        for batch in batches:
            given = batch.column(3).to_pylist() if batch.num_columns > 3 else None
            own: list[tuple[float, str, int, bool] | None] = [None] * batch.num_rows
            for i, text in enumerate(batch.column(2).to_pylist()):
                matcher = general
                if given is not None and given[i]:
                    matcher = general.knowing(np.array([g["word"] for g in given[i]], dtype=np.int64).view(np.uint64), np.array([g["n"] for g in given[i]]))
                notices = _notices(text)
                best, matched = None, []
                for (line, end, _), words in zip(notices, _words([t for *_, t in notices])):
                    cosine, name = matcher.match(words)
                    if cosine >= similarity:
                        matched.append((name, line, end))
                        if best is None or cosine > best[0]:
                            best = (cosine, name, line)
                all_words = _words([text])[0]
                if len(all_words) >= LEAST_TEXT:
                    cosine, name = matcher.match(all_words, whole=True)
                    if cosine >= WHOLE_SIMILARITY:
                        own[i] = (cosine, name, 0, True)
                        continue
                if best is not None:
                    lines = text.split("\n")
                    held = sorted({k for name, line, end in matched if name == best[1] for k in range(line, end)})
                    n_held = sum(map(len, _words([lines[k] for k in held])))
                    own[i] = (*best, n_held > file_share * len(all_words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([o and o[1] for o in own], pa.string()), pa.array([o and o[0] for o in own], pa.float64()), pa.array([o and o[2] for o in own], pa.int32()), pa.array([bool(o and o[3]) for o in own])],
                names=["doc_id", "path", "own", "cosine", "line", "whole"],
            )

    return scan


def _directory(path: Column) -> Column:
    """The directory of a path, without a closing slash; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def licenses(docs: DataFrame, similarity: float = SIMILARITY, file_share: float = FILE_SHARE, path: str | None = "path", text: str = "text", doc_id: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, path, license, origin, cosine, line, from_path) for every file.

    A notice is a line with a word such as `license`, it and the next one, or the block of lines
    around it; a text of 60 words or more is compared as a whole with the full texts of licences too (cosine 0.85).
    Its sparse TF-IDF vector is compared with the templates'; the licence with the highest cosine,
    0.75 at least, is the file's own (origin `header`; equal cosines go to the earliest notice,
    then to the first licence by name). Document frequencies are counted over all documents, of the
    templates' words and of all others in notices that could reach the least cosine.

    A licence file has its own licence, and is the licence's full text by its cosine, has a name
    such as LICENSE, or more than half of its words in notices of that licence, all taken together
    (origin `file`). A file without a licence of its own inherits that of the
    nearest directory above it, or its own directory, that holds a licence file (origin
    `inherited`, from_path names the licence file). Of several licence files in a directory the
    one with the highest cosine counts, then the first by licence, path and doc_id. Others have a
    null licence and the origin `none`.

    Directories, not files, are joined: each distinct directory's ancestors against the directories
    that hold licence files. Without a path column (None) paths are null and nothing is inherited. Null paths are in no directory; null and empty texts have no notice.
    Every row is judged, also repeated ones and those with a null doc_id. Empty tables give an
    empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    matcher = fit(tuned(docs), text)
    texts = docs.select(F.col(text).cast("string").alias("text")).filter("text <> ''")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.lit(None) if path is None else F.col(path)).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    # Only texts with a hint are looked at more than once; they are picked on the JVM.
    may = F.coalesce(F.col("text").rlike(f"(?i){HINT}"), F.lit(False))
    hinted = stored(rows.filter(may), "hinted")
    keyed = hinted.select(F.xxhash64("text").alias("key"), "text")
    wanted = stored(keyed.mapInArrow(_wanted(spark.sparkContext.broadcast(matcher), similarity), "key long, word long").distinct(), "words")
    words = wanted.select("word").distinct()
    small = 16 * words.count() <= broadcast_bytes
    if small:
        vocabulary = np.sort(words.toArrow().column("word").to_numpy().view(np.uint64))
        if len(vocabulary):
            counts = texts.mapInArrow(_frequencies(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
            matcher = matcher.knowing(counts.column("word").to_numpy().view(np.uint64), counts.column("n").to_numpy())
    shared, looked = spark.sparkContext.broadcast(matcher), hinted
    if not small:  # each text meets the frequencies of its own words
        counts = texts.mapInArrow(_all_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        known = wanted.join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("words"))
        looked = hinted.withColumn("key", F.xxhash64("text")).join(known, "key", "left").select("doc_id", "path", "text", "words")
    scanned = looked.mapInArrow(_scan(shared, similarity, file_share), "doc_id long, path string, own string, cosine double, line int, whole boolean")
    none = rows.filter(~may).select("doc_id", "path", *(F.lit(None).cast(k).alias(n) for n, k in (("own", "string"), ("cosine", "double"), ("line", "int"))), F.lit(False).alias("whole"))
    scanned = scanned.unionByName(none)
    scanned = stored(scanned.withColumn("is_file", F.col("own").isNotNull() & (F.col("whole") | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))).withColumn("dir", _directory(F.col("path"))), "notices")
    release(hinted, wanted)
    own_origin = F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header")
    if path is None:
        return scanned.select("doc_id", "path", F.col("own").alias("license"), own_origin.otherwise("none").alias("origin"), "cosine", "line", F.lit(None).cast("string").alias("from_path"))
    order = F.struct((-F.col("cosine")).alias("c"), "own", "path", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"))
    held = scanned.filter("is_file and dir is not null").groupBy("dir").agg(F.min(order).alias("b")).select("dir", F.col("b.own").alias("_license"), F.col("b.path").alias("_from"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = scanned.filter("own is null and dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(F.concat(above, F.array("dir")))).alias("up"))
    nearest = dirs.join(held.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("_license", "_from"), F.length("up")).alias("b")).select("dir", "b.*")
    out = scanned.join(nearest, "dir", "left")
    inherits = F.col("own").isNull() & F.col("_license").isNotNull()
    origin = own_origin.when(inherits, "inherited").otherwise("none")
    return out.select("doc_id", "path", F.when(inherits, F.col("_license")).otherwise(F.col("own")).alias("license"), origin.alias("origin"), "cosine", "line", F.when(inherits, F.col("_from")).alias("from_path"))
