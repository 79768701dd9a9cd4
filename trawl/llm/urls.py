"""Exact URL filters through a cascade of Bloom filters over the corpus's complete key universe."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.arrowtext import mix
from trawl.llm.exchange import stored

#: Keys whose pages are unwanted: a domain covers its subdomains, a key with a path that one page.
LISTED = (
    "adult-cams.example.com", "casino-bonus.example.net", "cheap-pills.example.com", "click-bait.example.net", "content-farm.example.org", "fake-news.example.com",
    "free-downloads.example.net", "keyword-stuffing.example.org", "link-farm.example.com", "malware-host.example.net", "phishing-site.example.org", "replica-watches.example.com",
    "scraper-site.example.net", "spam-farm.example.org", "warez-mirror.example.org",
)
#: Filters of more bytes than this aren't shipped to the tasks; membership is then decided by a join.
BROADCAST_BYTES = 256 << 20

#: Once so few keys are left to tell apart, the cascade is finished on the driver: 16 bytes a key.
DRIVER_KEYS = 500_000

#: Host of a URL in lower case, and host with path: scheme, user, port, query, fragment and a closing slash don't count.
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)"
PAGE = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/:?#]+(?::[0-9]*)?(/[^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host of a URL; null if it has none."""
    found = F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit("."))
    return F.when(found != "", found)


def url_keys(url: Column) -> Column:
    """Keys of a URL from the most to the least specific: host with path, host, and its parent domains of two labels or more."""
    h = host(url)
    parts = F.split(h, r"\.")
    n = F.size(parts)
    domains = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array(h))
    page = F.concat(h, F.rtrim(F.regexp_extract(F.lower(url), PAGE, 1), F.lit("/")))
    return F.when(h.isNotNull(), F.array_distinct(F.concat(F.array(page), domains)))


class Bloom:
    """A Bloom filter of m bits and k hashes; positions come from two 64-bit hashes of a key, salted so that each level errs on its own."""

    def __init__(self, n: int, p: float, salt: int = 0):
        self.salt = mix(np.array([salt + 1], dtype=np.uint64))[0]
        p = min(0.5, max(p, 1e-9))
        self.k = max(1, round(-math.log2(p)))
        self.m = max(64, -(-math.ceil(n * self.k / math.log(2)) // 64) * 64)
        self.words = np.zeros(self.m // 64, dtype=np.uint64)

    def positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = mix(b.view(np.uint64) ^ self.salt) | np.uint64(1)
        return (mix(a.view(np.uint64) ^ self.salt)[:, None] + np.arange(self.k, dtype=np.uint64) * step[:, None]) % np.uint64(self.m)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.positions(a, b)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)

    def fill(self, keys: DataFrame | pa.Table) -> Bloom:
        """Sets the bits of all keys (a, b): tasks send 64-bit words, which Spark combines by OR."""
        shape = Bloom.__new__(Bloom)
        shape.k, shape.m, shape.salt = self.k, self.m, self.salt

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(shape.positions(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                word = (at >> np.uint64(6)).astype(np.int64)
                new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), new) if len(new) else at
                yield pa.RecordBatch.from_arrays([pa.array(word[new]), pa.array(value.view(np.int64))], names=["word", "bits"])

        if isinstance(keys, pa.Table):
            for batch in bits(iter(keys.select(["a", "b"]).combine_chunks().to_batches())):
                self.words[batch.column(0).to_numpy()] |= batch.column(1).to_numpy().view(np.uint64)
            return self
        found = keys.select("a", "b").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return self


class Cascade:
    """Levels that encode, by turns, listed keys and the unlisted keys that the level before takes for listed."""

    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe: the number of levels that a key passes is odd if it is listed."""
        passed = np.zeros(len(a), dtype=np.int64)
        alive = np.arange(len(a))
        for level in self.levels:
            alive = alive[level.has(a[alive], b[alive])]
            passed[alive] += 1
        return passed % 2 == 1

    @staticmethod
    def build(universe: DataFrame, most_bytes: int = BROADCAST_BYTES) -> Cascade | None:
        """From (a, b, listed), all keys of the corpus; None if the filters would exceed most_bytes.

        The first level's rate of false positives is sqrt(1/2) times the ratio of listed to other
        keys, so the levels after it are about as large as the list and their number stays small.
        """
        spark, out = universe.sparkSession, Cascade()
        sides = [universe.filter("listed"), universe.filter("not listed")]
        sizes = [s.count() for s in sides]
        p = math.sqrt(0.5) * sizes[0] / max(1, sizes[1])
        used, side = 0, 0
        while sizes[side]:
            level = Bloom(sizes[side], p if not out.levels else 0.5, len(out.levels))
            used += level.m // 8
            if used > most_bytes:
                return None
            level.fill(sides[side])
            out.levels.append(level)
            side = 1 - side
            if out.levels[1:] and sum(sizes) <= DRIVER_KEYS:
                # What is left fits in the driver's memory, so the last, ever smaller levels need no jobs.
                sides = [x if isinstance(x, pa.Table) else x.select("a", "b").toArrow() for x in sides]
                has = level.has(sides[side].column("a").to_numpy(), sides[side].column("b").to_numpy())
                sides[side] = sides[side].filter(pa.array(has))
                sizes[side] = sides[side].num_rows
                continue
            shared = spark.sparkContext.broadcast(level)

            def passing(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array(shared.value.has(batch.column(0).to_numpy(), batch.column(1).to_numpy())))

            sides[side] = stored(sides[side].select("a", "b").mapInArrow(passing, "a long, b long"), "passing")
            sizes[side] = sides[side].count()
        return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")]


def url_filter(pages: DataFrame, listed: DataFrame, url: str = "url", page_id: str = "page_id", key: str = "key", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, host, listed, matched) for every page: whether a key of its URL is on the list.

    Keys of a URL are its host with its path, its host, and the host's parent domains of at least
    two labels, in lower case, without scheme, user, port, query, fragment, closing slash or dot.
    `matched` is the most specific listed key. The list holds such keys, cleaned the same way.

    All distinct keys of the corpus are the universe. A cascade of Bloom filters built over it
    answers exactly for each of them, so pages are judged in one map pass without a join. Filters
    grow with the list, and hardly with the corpus; beyond `most_bytes` the pages' keys are joined
    with the list instead, with the same result.

    A null or empty URL, or one without a host, is not listed and has no host. Null and blank keys of the
    list are ignored, repeated ones count once. Every row is judged, also repeated ones and those
    with a null page_id. Empty tables give an empty result, or nothing listed. Extra columns are
    ignored.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    keyed = rows.withColumn("_keys", url_keys(F.col("url")))
    clean = F.trim(F.lower(F.col(key).cast("string")))
    wanted = listed.select(F.rtrim(F.rtrim(clean, F.lit("/")), F.lit(".")).alias("key")).filter("key <> ''").distinct()
    distinct = keyed.select(F.explode("_keys").alias("key")).distinct()
    universe = stored(distinct.join(wanted.withColumn("listed", F.lit(True)), "key", "left").select(*_hashes(F.col("key")), F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    cascade = Cascade.build(universe, most_bytes)
    if cascade is None:
        ids = rows.withColumn("_row", F.monotonically_increasing_id())
        ids = stored(ids, "urls")
        hits = ids.select("_row", F.posexplode(url_keys(F.col("url"))).alias("_at", "key")).join(wanted, "key").groupBy("_row").agg(F.min_by("key", "_at").alias("matched"))
        return ids.join(hits, "_row", "left").select("page_id", "url", host(F.col("url")).alias("host"), F.col("matched").isNotNull().alias("listed"), "matched")
    shared = pages.sparkSession.sparkContext.broadcast(cascade)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            counts = np.diff(a.offsets.to_numpy())
            hit = shared.value.has(a.flatten().to_numpy(), b.flatten().to_numpy())
            first = np.cumsum(counts) - counts
            at = np.full(len(counts), -1, dtype=np.int64)
            where = np.flatnonzero(hit)[::-1]
            row = np.repeat(np.arange(len(counts)), counts)
            at[row[where]] = where - first[row[where]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at)], names=["page_id", "url", "_at"])

    none = F.array().cast("array<string>")
    hashed = keyed.select("page_id", "url", F.transform(F.coalesce("_keys", none), lambda k: F.xxhash64(k)).alias("a"), F.transform(F.coalesce("_keys", none), lambda k: F.xxhash64(F.lit(1), k)).alias("b"))
    judged = hashed.mapInArrow(judge, "page_id long, url string, _at long")
    matched = F.when(F.col("_at") >= 0, F.get(url_keys(F.col("url")), F.col("_at").cast("int")))
    return judged.select("page_id", "url", host(F.col("url")).alias("host"), (F.col("_at") >= 0).alias("listed"), matched.alias("matched"))


def listed_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in LISTED], "key string")


def oracle(keys: tuple[str, ...] = LISTED) -> str:
    """DuckDB SQL for url_filter over `pages` with a list of domains."""
    values = ", ".join(f"('{k}')" for k in keys)
    return f"""
WITH listed(key) AS (VALUES {values}),
p AS (SELECT page_id, url, nullif(rtrim(regexp_extract(lower(url), '{HOST}', 1), '.'), '') AS host FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
m AS (SELECT host, arg_max(key, length(key)) AS matched FROM h JOIN listed ON host = key OR ends_with(host, '.' || key) GROUP BY host)
SELECT page_id, url, p.host, matched IS NOT NULL AS listed, matched FROM p LEFT JOIN m ON p.host = m.host
"""
