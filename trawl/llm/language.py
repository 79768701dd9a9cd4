"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.arrowtext import buffers, mix, slices, trimmed
from trawl.llm.exchange import by_slot, gathered, n_slots, slot_of, stored, tuned

ORDER = 4
DISCOUNT = 0.75
#: Models that take at most this many bytes are shipped to every task; grams meet larger ones in slots.
BROADCAST_BYTES = 64 << 20
#: A document is rejected beyond this many deviations (of its length class) above its language's median.
DEVIATIONS = 8.0
#: Deviations are never taken as less than this many bits a character.
LEAST_DEVIATION = 0.05
LENGTH_CLASSES = (0, 100, 1000)
#: Text whose grams are held at a time (or one longer text's): some hundred bytes of arrays a character.
GRAM_BYTES = 1 << 17

_SYMBOLS = np.zeros(1 << 16, dtype=bool)
_SYMBOLS[:128] = [not chr(c).isalpha() for c in range(128)]
for _a, _b in ((0x80, 0xAA), (0xAB, 0xB5), (0xB6, 0xBA), (0xBB, 0xC0), (0x2000, 0x2070), (0x20A0, 0x20D0), (0x2190, 0x2C00), (0x3000, 0x3040)):
    _SYMBOLS[_a:_b] = True
_SYMBOLS[1] = False
_START, _SPACE = 1, 32


def _normal(codes: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters with each run of other than letters as one space, the first `kept` as they are; and which ones stay."""
    codes = np.minimum(codes, 0xFFFF)
    blank = _SYMBOLS[codes]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[:kept] = True
    return np.where(blank, _SPACE, codes)[keep].astype(np.uint64), keep


def _packed(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - ORDER + 1
    grams = codes[:n].copy() if n > 0 else codes[:0]
    for k in range(1, ORDER):
        grams <<= np.uint64(16)
        grams |= codes[k : n + k] if n > 0 else codes[:0]
    return grams


def _decoded(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)


def _gram_parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """For each slice: first row, end row, packed grams of ORDER characters, how many each row has, and whether the last row ends here.

    Letters are lower-cased; every run of other characters is one space. Each text is led by
    ORDER - 1 start marks, so a text of n (remaining) characters has n grams. A text longer than
    two slices comes in parts that give the same grams.
    """
    marks = chr(_START) * (ORDER - 1)
    raw, rough = buffers(column)
    for i, j in slices(rough, GRAM_BYTES):
        at, end = int(rough[i]), int(rough[j])
        if j - i == 1 and end - at > 2 * GRAM_BYTES:
            carry = np.full(ORDER - 1, _START, dtype=np.uint32)
            while at < end:
                to = min(end, at + GRAM_BYTES)
                while to < end and raw[to] & 0xC0 == 0x80:
                    to += 1
                own, _ = buffers(pc.utf8_lower(pa.array([raw[at:to].tobytes()], pa.binary()).cast(pa.large_string())))
                codes, _ = _normal(np.concatenate([carry, _decoded(own)]), ORDER - 1)
                grams, carry, at = _packed(codes), codes[-(ORDER - 1) :].astype(np.uint32), to
                yield i, j, grams, np.array([len(grams)]), at >= end
            continue
        own = pc.fill_null(pc.utf8_lower(column.slice(i, j - i).cast(pa.large_string())), "")
        data, offsets = buffers(pc.binary_join_element_wise(pa.scalar(marks, pa.large_string()), own, pa.scalar("", pa.large_string())))
        first = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))[offsets]
        codes, keep = _normal(_decoded(data), 0)
        first = np.concatenate([[0], np.cumsum(keep)])[first]
        grams = _packed(codes)
        inside = np.ones(len(grams), dtype=bool)
        for k in range(ORDER - 1):
            cut = first[1:-1] - 1 - k
            inside[cut[(cut >= 0) & (cut < len(inside))]] = False
        yield i, j, grams[inside], np.diff(first) - (ORDER - 1), True


def _grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return (x[:4] for x in _gram_parts(column))


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[new], np.add.reduceat(counts, new) if len(new) else counts

    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        label, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
        for i, j, grams, sizes in _grams(batch.column(1)):
            owner = np.repeat(label[i:j], sizes)
            for k, name in enumerate(names):
                own = np.sort(grams[owner == k])
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                parts = held.setdefault(name, [])
                parts.append((own[new], np.diff(np.append(new, len(own))).astype(np.int64)))
                if len(parts) > 16:
                    parts[:] = [merged(parts)]
    for name, parts in held.items():
        keys, counts = merged(parts)
        for i in range(0, len(keys), 100_000):
            k = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(counts[i : i + 100_000])], names=["lang", "gram", "n"])


class _Counts:
    """Counts of one order in one language, with totals and types by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        context = keys >> np.uint64(16)
        self.contexts, first = np.unique(context, return_index=True)
        self.totals = np.add.reduceat(counts, first) if len(first) else counts
        self.types = np.diff(np.append(first, len(keys)))


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.float64)


class Model:
    """Per order: hashes of all grams in ascending order, and log2 probabilities and back-off weights by language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], discount: float = DISCOUNT, pairs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        """Of a part of the grams that holds all with the same middle, given the continuation counts of all pairs of characters."""
        self.languages = sorted(counts if pairs is None else pairs)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))] * (ORDER + 1)
        self.backoffs = list(self.tables)
        orders: dict[str, list[_Counts | None]] = {}
        alphabet = 1
        for name in self.languages:
            keys, n = counts.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            order = np.argsort(keys)
            own: list[_Counts | None] = [None] * (ORDER + 1)
            own[ORDER] = _Counts(keys[order], n[order].astype(np.float64))
            for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many types of the next order a gram ends
                if k == 2 and pairs is not None:
                    types, n_types = pairs[name]
                    order = np.argsort(types)
                    types, n_types = types[order], n_types[order]
                else:
                    types, n_types = np.unique(own[k + 1].keys & np.uint64((1 << (16 * k)) - 1), return_counts=True)
                own[k] = _Counts(types, n_types.astype(np.float64))
            orders[name] = own
            alphabet = max(alphabet, len(own[1].keys))
        self.floor = -np.log2(alphabet + 1)
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([orders[x][k].keys for x in self.languages]))
            contexts = np.unique(np.concatenate([orders[x][k].contexts for x in self.languages]))
            logs = np.stack([np.log2(self._probability(orders[x], k, keys, discount, alphabet)) for x in self.languages], axis=1).astype(np.float32)
            weights = []
            for x in self.languages:
                own = orders[x][k]
                total = _find(own.contexts, own.totals, contexts)
                weights.append(np.where(total > 0, np.log2(discount * np.maximum(_find(own.contexts, own.types, contexts), 1) / np.maximum(total, 1)), 0))
            for to, at, values in ((self.tables, keys, logs), (self.backoffs, contexts, np.stack(weights, axis=1).astype(np.float32))):
                hashes = mix(at)
                order = np.argsort(hashes)
                to[k] = (hashes[order], values[order])

    @staticmethod
    def _probability(own: list, k: int, grams: np.ndarray, discount: float, alphabet: int) -> np.ndarray:
        if k == 0:
            return np.full(len(grams), 1 / (alphabet + 1))
        c = own[k]
        lower = Model._probability(own, k - 1, grams & np.uint64((1 << (16 * (k - 1))) - 1), discount, alphabet)
        context = grams >> np.uint64(16)
        total, types = _find(c.contexts, c.totals, context), _find(c.contexts, c.types, context)
        seen = (np.maximum(_find(c.keys, c.counts, grams) - discount, 0) + discount * types * lower) / np.maximum(total, 1)
        return np.where(total > 0, seen, lower)

    def scores(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """log2 probability of each gram's last character after the others, by language."""
        if k == 0:
            return np.full((len(grams), len(self.languages)), self.floor, dtype=np.float32)
        keys, logs = self.tables[k]
        hashes = mix(grams)
        if not len(keys):
            return self.scores(grams & np.uint64((1 << (16 * (k - 1))) - 1), k - 1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        missing = np.flatnonzero(keys[at] != hashes)
        out = logs[at]
        if len(missing):
            rest = grams[missing]
            out[missing] = self.scores(rest & np.uint64((1 << (16 * (k - 1))) - 1), k - 1)
            keys, weights = self.backoffs[k]
            hashes = mix(rest >> np.uint64(16))
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            out[missing] += np.where((keys[at] == hashes)[:, None], weights[at], 0)
        return out


def counted(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, half, gram, n): how often each gram of characters occurs in the labelled documents of a language, by the half of the corpus that a text's hash puts it in."""
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null and lang <> '' and text <> ''")
    parts = [known.filter(_half(F.col("text")) == h).mapInArrow(_count, "lang string, gram long, n long").withColumn("half", F.lit(h)) for h in (0, 1)]
    return stored(parts[0].unionAll(parts[1]).groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")), "grams")


def _half(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), text), F.lit(2)).cast("int")


def _others(counts: DataFrame, half: int) -> DataFrame:
    """(lang, gram, n) of the other half, and of languages that it has no text of, of this one."""
    there = [r["lang"] for r in counts.filter(F.col("half") != half).select("lang").distinct().collect()]  # a row a language
    return counts.filter((F.col("half") != half) | ~F.col("lang").isin(there)).select("lang", "gram", "n")


def _by_language(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    codes = table.column("lang").combine_chunks().dictionary_encode()
    label, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
    grams, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    return {name: (grams[label == k], n[label == k]) for k, name in enumerate(names)}


def _model(grams: DataFrame) -> Model | None:
    counts = _by_language(grams.select("lang", "gram", "n").toArrow())
    return Model(counts) if counts else None


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rarest: float = 0.0) -> Model | None:
    """Counts the character grams of all labelled documents; None if there are none.

    Every counted gram is kept unless `rarest` is given: then those rarer than this share of their language's go.
    """
    grams = counted(docs, text, lang).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    if rarest > 0:
        least = grams.groupBy("lang").agg((F.sum("n") * rarest).alias("least"))
        grams = grams.join(F.broadcast(least), "lang").filter("n >= least")
    return _model(grams)


def _middle(grams: np.ndarray) -> np.ndarray:
    """The two characters in the middle: all that orders 4 and 3 know about a gram is in the grams with the same."""
    return (grams >> np.uint64(16)) & np.uint64(0xFFFFFFFF)


def _judged(bits: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of bits by language: the best language, its bits, and how many more the next takes."""
    ranked = np.sort(bits, axis=1)
    return names[np.argmin(bits, axis=1)], ranked[:, 0], ranked[:, 1] - ranked[:, 0] if len(names) > 1 else np.zeros(len(bits))


def _has_letters(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    letters = np.concatenate([[0], np.cumsum(grams & np.uint64(0xFFFF) != _SPACE)])
    return letters[ends] - letters[ends - sizes] > 0


_ROW = "doc_id long, predicted string, bits double, margin double, n_chars long, text_hash long"


def _scored_by_broadcast(rows: DataFrame, model: Model | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names, held = np.array(model.languages if model else [""], dtype=object), None
        for batch in batches:
            for i, j, grams, sizes, whole in _gram_parts(batch.column(1)):
                ends = np.cumsum(sizes)
                ok = _has_letters(grams, sizes) & (model is not None)
                bits = np.zeros((j - i, len(names)))
                if model is not None and len(grams):
                    logs = model.scores(grams)
                    for k in range(len(names)):
                        total = np.concatenate([[0], np.cumsum(logs[:, k], dtype=np.float64)])
                        bits[:, k] = -(total[ends] - total[ends - sizes])
                if held is not None:  # parts of one text add up
                    bits, sizes, ok = bits + held[0], sizes + held[1], ok | held[2]
                held = None if whole else (bits, sizes, ok)
                if not whole:
                    continue
                bits = np.where(ok[:, None], bits / np.maximum(sizes, 1)[:, None], np.inf)
                best, least, margin = _judged(bits, names)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(best, pa.string(), mask=~ok), pa.array(least, mask=~ok), pa.array(margin, mask=~ok), pa.array(sizes.astype(np.int64)), batch.column(2).slice(i, j - i)],
                    names=["doc_id", "predicted", "bits", "margin", "n_chars", "text_hash"],
                )

    return rows.mapInArrow(score, _ROW)


def _scored_by_slot(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from a model in parts: the texts' grams are sent to the slot of their middle, which holds the part they need.

    Only pairs of characters are shipped to all tasks. A text's bits are the mean over its grams,
    so rows with the same text can be summed together.
    """
    spark = rows.sparkSession
    length = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = n_slots(spark, length + counts.count())
    tails = counts.select("lang", F.col("gram").bitwiseAND(F.lit((1 << 48) - 1)).alias("gram")).distinct()
    pairs = spark.sparkContext.broadcast(_by_language(tails.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 32) - 1)).alias("gram")).agg(F.count("*").alias("n")).toArrow()))
    names = sorted(pairs.value)

    @trimmed
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_numpy().view(np.uint64)
            slot = slot_of(_middle(grams), slots)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns], names=["slot", "lang", "gram", "n"])

    @trimmed
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(2).to_numpy()
            for i, j, grams, sizes in _grams(batch.column(1)):
                if len(grams):
                    order = np.argsort(grams, kind="stable")
                    yield by_slot(slot_of(_middle(grams), slots)[order], slots, [grams[order], np.repeat(hashes[i:j], sizes)[order]], ["grams", "refs"])

    @trimmed
    def score(counts: pa.Table, texts: pa.Table) -> pa.Table:
        grams, refs = gathered(texts, "grams", np.uint64), gathered(texts, "refs", np.int64)
        refs, at = np.unique(refs, return_inverse=True)
        columns = [np.zeros(len(refs)) for _ in names]
        if len(grams):
            model = Model(_by_language(counts), pairs=pairs.value)
            for lo in range(0, len(grams), GRAM_BYTES):
                logs = model.scores(grams[lo : lo + GRAM_BYTES])
                for k in range(len(names)):
                    columns[k] += np.bincount(at[lo : lo + GRAM_BYTES], weights=logs[:, k], minlength=len(refs))
        return pa.table({"text_hash": pa.array(refs), "n": pa.array(np.bincount(at, minlength=len(refs)).astype(np.int64)), **{f"l{k}": pa.array(c) for k, c in enumerate(columns)}})

    @trimmed
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i, j, grams, n, whole in _gram_parts(batch.column(1)):
                ok = _has_letters(grams, n)
                if held is not None:
                    n, ok = n + held[0], ok | held[1]
                held = None if whole else (n, ok)
                if whole:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(ok)], names=["doc_id", "text_hash", "n_chars", "ok"])

    @trimmed
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = batch.column(3).to_numpy(zero_copy_only=False)
            bits = np.stack([-batch.column(4 + k).to_numpy(zero_copy_only=False) for k in range(len(names))], axis=1)
            best, least, margin = _judged(np.where(ok[:, None], bits, np.inf), np.array(names, dtype=object))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string(), mask=~ok), pa.array(least, mask=~ok), pa.array(margin, mask=~ok), batch.column(2), batch.column(1)], names=["doc_id", "predicted", "bits", "margin", "n_chars", "text_hash"])

    model = counts.mapInArrow(part, "slot long, lang string, gram long, n long").groupBy("slot")
    texts = rows.mapInArrow(send, "slot long, grams binary, refs binary").groupBy("slot")
    sums = model.cogroup(texts).applyInArrow(score, "text_hash long, n long, " + ", ".join(f"l{k} double" for k in range(len(names))))
    means = stored(sums.groupBy("text_hash").agg(*((F.sum(f"l{k}") / F.sum("n")).alias(f"l{k}") for k in range(len(names)))), "means")
    judged = rows.mapInArrow(sizes, "doc_id long, text_hash long, n_chars long, ok boolean").join(means, "text_hash", "left")
    return judged.select("doc_id", "text_hash", "n_chars", "ok", *(f"l{k}" for k in range(len(names)))).mapInArrow(judge, _ROW)


def languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, predicted, bits, margin, n_chars, accepted, text_hash) for every document.

    One model per value of the label column, counted over all labelled documents: interpolated
    Kneser-Ney over 4 characters, kept as sorted arrays of gram hashes. `predicted` has the lowest
    cross-entropy in bits a character, `bits`; `margin` is how much more the next language takes.
    A text is rejected if its bits exceed the median of its language and length class by more than
    DEVIATIONS times the median absolute deviation. Texts are halved by their hash, and each is
    judged by the model of the other half (a language that half lacks by its own), so bounds are
    calibrated on texts that the models haven't seen, and a text can't vouch for itself.

    A null or empty text, or one without letters, has no prediction and is rejected. If no document
    has a label, nothing can be predicted and everything is rejected. Equal cross-entropies go to
    the first language by name. Every row is judged by itself, also if its doc_id is null or
    repeated, and equal texts are judged alike, so `text_hash` (Spark's xxhash64) finds the rows a
    judgement is about. Extra columns are ignored.

    Texts of any length are read whole, in parts of bounded memory. An empty table gives an empty result. Every counted gram is in the model, at every size. Models of at most 64 MB go to all tasks;
    beyond that the texts' grams meet their part of the model in slots, with the same result.
    """
    rows = tuned(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    counts, scored = counted(docs, text, lang), None
    half = F.coalesce(_half(F.col("text")), F.lit(0))
    for h in (0, 1):
        own, grams = rows.filter(half == h), _others(counts, h)
        n_languages, n_grams = grams.agg(F.count_distinct("lang"), F.count_distinct("gram")).first()
        # The highest order has most of a model's grams: a hash and a logarithm a language each.
        small = n_grams * (8 + 4 * n_languages) <= broadcast_bytes or not n_grams
        part = stored(_scored_by_broadcast(own, _model(grams)) if small else _scored_by_slot(own, grams), "languages")
        scored = part if scored is None else scored.unionAll(part)
    scored = scored.withColumn("_class", sum((F.col("n_chars") >= x).cast("int") for x in LENGTH_CLASSES))
    group = ["predicted", "_class"]
    middle = scored.filter("predicted is not null").groupBy(*group).agg(F.percentile_approx("bits", 0.5, 10000).alias("_mid"))
    spread = scored.join(F.broadcast(middle), group).groupBy(*group).agg(F.first("_mid").alias("_mid"), F.percentile_approx(F.abs(F.col("bits") - F.col("_mid")), 0.5, 10000).alias("_mad"))
    bound = spread.select(*group, (F.col("_mid") + DEVIATIONS * F.greatest(F.col("_mad"), F.lit(LEAST_DEVIATION))).alias("_bound"))
    out = scored.join(F.broadcast(bound), group, "left")
    return out.select("doc_id", "predicted", F.round("bits", 6).alias("bits"), F.round("margin", 6).alias("margin"), "n_chars", F.coalesce(F.col("bits") <= F.col("_bound"), F.lit(False)).alias("accepted"), "text_hash")
