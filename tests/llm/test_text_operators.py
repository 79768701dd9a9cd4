"""Language ID, repetition, repeats, decontamination, lines and SimHash against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trawl.llm import decontaminate, language, lines, queries, repetition, simhash, substrings

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def odd(spark, schema="doc_id long, text string, lang string, source string, n_chars long, slot long, node long, keep boolean"):
    """Nulls in any column, empty and very long texts, repeated rows, and names the operators use themselves."""
    line = "the quick brown fox jumps over the lazy dog near the river bank"
    long = " ".join(f"word{i}" for i in range(120_000))
    some = [
        (1, line, "en", "a", 10, 1, 1, True),
        (1, line, "en", "a", 10, 1, 1, True),
        (2, None, "en", None, None, None, None, None),
        (3, "", None, "a", 0, 1, 1, False),
        (None, line, "en", "a", 10, 1, 1, True),
        (4, " \n\n\t ", "en", "a", 5, 1, 1, True),
        (5, long, "en", "a", len(long), 1, 1, True),
        (6, line + "\n" + line.replace("quick", "quiet"), None, "a", 10, 1, 1, True),
        (7, "%%% 123 ---", "de", "a", 10, 1, 1, True),
        (None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(some, schema), line


# Language ID


def normal(text):
    out = re.sub(r"[^a-zà-öø-ÿœßāăą0-ɏ]", " ", text.lower())
    return re.sub(r" +", " ", re.sub(r"[\W\d_]+", " ", out))


def test_kneser_ney_equals_the_formula(spark):
    texts = ["the cat sat on the mat the cat ran", "that cat was there then"]
    df = spark.createDataFrame([(1, texts[0], "en"), (2, texts[1], "en"), (3, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    model = language.fit(df, rarest=0.0)
    for name, own in (("en", texts), ("de", ["der hund und die katze"])):
        p, _ = brute.kneser_ney(own, language.ORDER, language.DISCOUNT)
        alphabet = max(brute.kneser_ney(x, language.ORDER, language.DISCOUNT)[1] for x in (texts, ["der hund und die katze"]))
        probe = "the dog and die katze xyz"
        _, _, grams, sizes = next(iter(language._grams(pa.array([probe]))))
        assert sizes.tolist() == [len(probe)]
        got = model.scores(grams)[:, model.languages.index(name)]
        padded = "\x01" * (language.ORDER - 1) + probe
        want = [np.log2(p(padded[i : i + language.ORDER], alphabet)) for i in range(len(probe))]
        np.testing.assert_allclose(got, want, atol=1e-4)


def test_language_held_out_accuracy(spark, docs):
    train, held = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    unlabelled = held.withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string"))
    out = language.languages(train.withColumn("truth", F.lit(None).cast("string")).unionByName(unlabelled))
    judged = out.join(unlabelled.select("doc_id", "truth"), "doc_id").filter("n_chars >= 50")
    right = judged.agg(F.avg((F.col("predicted") == F.col("truth")).cast("double"))).first()[0]
    assert judged.count() > 30 and right >= 0.97


def test_language_keeps_prose_and_rejects_noise(spark, docs):
    rng = np.random.default_rng(3)
    noise = [(900_000 + i, " ".join("".join(rng.choice(list("qxzjkvwpb"), 9)) for _ in range(200)), None, "x", 1) for i in range(3)]
    out = {r["doc_id"]: r["accepted"] for r in language.languages(docs.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(noise, "doc_id long, text string, lang string, source string, n_chars long"))).collect()}
    assert not any(out[900_000 + i] for i in range(3))
    prose = [r["doc_id"] for r in docs.filter(F.length("text") > 200).collect()]
    assert np.mean([out[d] for d in prose]) >= 0.97


def test_language_edges(spark):
    df, _ = odd(spark)
    out = language.languages(df).collect()
    assert len(out) == df.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["predicted"] for r in by[2] + by[3] + by[4] + by[7]] == [None] * 4
    assert not any(r["accepted"] for r in by[2] + by[3] + by[4] + by[7])
    assert len(by[1]) == 2 and by[1][0]["predicted"] in ("de", "en")
    assert language.languages(df.limit(0)).count() == 0
    assert not any(r["accepted"] for r in language.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_language_models_keep_rare_grams_of_large_corpora(spark):
    common = spark.range(58, numPartitions=4).select(F.repeat(F.lit("abcdefgh "), 400_000).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([("qzjx", "en")], "text string, lang string")
    model = language.fit(common.unionAll(rare))  # over 2e8 characters, of which one is in this gram
    _, _, grams, _ = next(iter(language._grams(pa.array(["qzjx"]))))
    assert np.isin(language.mix(grams), model.tables[language.ORDER][0]).all()


def test_long_texts_have_the_same_grams_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcé ßÄ,. \n1漢"), n)) for n in (0, 1, 5, 900, 4000)] + [None]
    whole = [(sizes, grams) for *_, grams, sizes in language._grams(pa.array(texts))]
    monkeypatch.setattr(language, "GRAM_BYTES", 100)
    sums, grams = np.zeros(len(texts), int), []
    for i, j, g, sizes in language._grams(pa.array(texts)):
        sums[i:j] += sizes
        grams.append(g)
    assert sums.tolist() == np.concatenate([s for s, _ in whole]).tolist()
    assert np.concatenate(grams).tolist() == np.concatenate([g for _, g in whole]).tolist()


def test_language_in_slots_gives_what_the_broadcast_gives(spark, docs):
    odd_docs, _ = odd(spark)
    some = docs.select("doc_id", "text", "lang").unionAll(odd_docs.select("doc_id", "text", "lang"))
    by = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"] or 0)
    a, b = (sorted(language.languages(some, broadcast_bytes=size).collect(), key=by) for size in (language.BROADCAST_BYTES, -1))
    assert len(a) == len(b) == some.count()
    for x, y in zip(a, b):
        assert [x[k] for k in ("doc_id", "predicted", "n_chars", "accepted", "text_hash")] == [y[k] for k in ("doc_id", "predicted", "n_chars", "accepted", "text_hash")]
        assert [x["bits"], x["margin"]] == pytest.approx([y["bits"], y["margin"]], abs=2e-6)


# Repetition


def test_repetition_equals_brute_force(docs, rows):
    lengths = tuple(repetition.NGRAM_LIMITS)
    for r in repetition.repetition(docs).collect():
        want = brute.repetition(dict(rows)[r["doc_id"]], lengths)
        assert {k: r[k] for k in want} == pytest.approx(want, abs=2e-6), r["doc_id"]


def test_repetition_edges(spark):
    df, line = odd(spark)
    spam = spark.createDataFrame([(8, "buy cheap pills now at this one shop " * 30), (9, "same line of text here\n" * 5)], DOCS)
    out = repetition.repetition(df.select("doc_id", "text").unionAll(spam)).collect()
    keep = [(r["doc_id"], r["keep"]) for r in out]
    assert len(out) == df.count() + 2
    # Document 6 is one sentence twice, but for a word.
    assert {d for d, k in keep if not k} == {6, 8, 9}
    assert repetition.repetition(df.limit(0)).count() == 0


# Repeats


def test_repeats_equal_brute_force(docs, rows):
    got = {tuple(r) for r in substrings.repeats(docs).select("doc_id", "start_word", "end_word", "n_words", "other_doc").collect()}
    assert got == brute.repeats(rows, substrings.LENGTH) and got


def test_repeats_small(spark):
    a = " ".join(f"a{i}" for i in range(30))
    some = [(1, "x y " + a + " z"), (2, a), (3, "q " + a + " r s " + a), (4, None), (5, ""), (None, a), (2, a), (6, "b " * 40), (7, " ".join(f"a{i}" for i in range(9)))]
    df = spark.createDataFrame([(*r, 1, "k") for r in some], "doc_id long, text string, slot long, key string")
    got = {tuple(r) for r in substrings.repeats(df, 10, 4).select("doc_id", "start_word", "end_word", "n_words", "other_doc").collect()}
    assert got == brute.repeats([r for r in some if r[0] is not None], 10)
    assert {d for d, *_ in got} == {1, 2, 3}
    assert substrings.repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.repeats(df, 5, 6)


def brute_passages(rows, length):
    """Each stretch's places; runs of stretches whose places move on together, by a loop over every word."""
    texts = {(d, t) for d, t in rows if d is not None}
    where = {}
    for d, t in texts:
        w = brute.words(t)
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), set()).add((d, t, i))
    places = {p: frozenset(s) for s in where.values() if len({d for d, *_ in s}) > 1 for p in s}
    out = []
    for (d, t, i), s in places.items():
        if places.get((d, t, i - 1)) != frozenset((a, b, k - 1) for a, b, k in s):
            j = i
            while places.get((d, t, j + 1)) == frozenset((a, b, k + j + 1 - i) for a, b, k in s):
                j += 1
            out.append((d, i, j + length, frozenset((a, k) for a, _, k in s), len({a for a, *_ in s}), min(a for a, *_ in s if a != d)))
    return out


def shown(found):
    by = {}
    for r in found:
        by.setdefault(r["passage_id"], []).append((r["doc_id"], r["start_word"]))
    return sorted((r["doc_id"], r["start_word"], r["end_word"], sorted(by[r["passage_id"]]), r["n_docs"], r["other_doc"]) for r in found)


def test_passages_keep_every_partner(spark, tmp_path):
    b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "bc")
    rows = [(1, b + " " + c), (2, "two " + b + " end"), (3, "three " + c), (4, b), (5, "five " + c + " " + c), (5, "else " + b), (5, "else " + b), (6, " ".join(b.split()[5:]))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op5_substrings(spark, str(tmp_path)).collect()
    assert shown(found) == sorted((d, i, j, sorted(p), n, o) for d, i, j, p, n, o in brute_passages(rows, substrings.LENGTH))
    assert {r["doc_id"] for p in found if p["doc_id"] == 1 for r in found if r["passage_id"] == p["passage_id"]} == {1, 2, 3, 4, 5, 6}


def test_passages_equal_brute_force(docs, rows):
    found = substrings.passages(docs).collect()
    assert found and shown(found) == sorted((d, i, j, sorted(p), n, o) for d, i, j, p, n, o in brute_passages(rows, substrings.LENGTH))


def test_repeats_edges(spark):
    df, _ = odd(spark)
    assert substrings.repeats(df).count() == 0


# Decontamination


def test_contaminated_equals_brute_force(spark, sf_dir, docs, rows):
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"], r["kind"], r["matched"]) for r in decontaminate.contaminated(docs, tests).collect()}
    want = brute.contaminated(rows, [(r["item_id"], r["text"]) for r in tests.collect()])
    assert got == want and got


def test_contaminated_small(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    w = item.split()
    near = " ".join(["zero", *w[:5], "inserted", *w[5:9], *w[10:]])
    some = [(1, "Prefix, " + item.upper() + "!"), (2, near), (3, " ".join(w[:12])), (4, " ".join(reversed(w))), (5, None), (6, ""), (None, item), (1, item), (7, " ".join(w[:7]) + "\n" + " ".join(w[7:]))]
    tests = [(10, item), (11, "too short an item"), (12, None), (None, item), (10, item), (13, "eight words are just enough for an item")]
    df = spark.createDataFrame([(*r, 1) for r in some], "doc_id long, text string, terms long")
    ts = spark.createDataFrame([(*r, 1) for r in tests], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"], r["kind"], r["matched"]) for r in decontaminate.contaminated(df, ts).collect()}
    assert got == brute.contaminated(some, tests)
    assert {(d, k) for d, _, k, _ in got} == {(1, "exact"), (2, "near"), (3, "near"), (7, "exact")}
    assert decontaminate.contaminated(df.limit(0), ts).count() == 0
    assert decontaminate.contaminated(df, ts.limit(0)).count() == 0


def test_contaminated_short_items_are_found_whole(spark):
    some = [(1, "He said: Yes, we can! And so"), (2, "yes we did can"), (3, "yes"), (4, "can yes we can")]
    tests = [(1, "yes we can"), (2, "Yes"), (3, "?!")]
    df, ts = spark.createDataFrame(some, DOCS), spark.createDataFrame(tests, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"], r["matched"]) for r in decontaminate.contaminated(df, ts).collect()}
    assert got == brute.contaminated(some, tests) == {(1, 1, "short", 3), (4, 1, "short", 3), *((d, 2, "short", 1) for d in (1, 2, 3, 4))}


def test_contaminated_long_texts_are_searched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 2000)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, 20 + 5 * i))) for i in range(6)]
    text = " ".join(" ".join(rng.choice(vocabulary, 300)) + " " + items[i % 6][1] for i in range(12))
    rows = [(1, text), (2, text.replace("w7 ", "ÄÖ ")), (3, "x" * 9000 + " " + items[3][1])]
    df, ts = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"], r["matched"]) for r in decontaminate.contaminated(df, ts).collect()}
    assert got == brute.contaminated(rows, items) and len(got) >= 13


def test_contaminated_chunks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 10)
    items = [(i, " ".join(f"t{i}w{j}" for j in range(14))) for i in range(4)]
    filler = " ".join(f"f{j}" for j in range(200_000))
    df = spark.createDataFrame([(1, filler + " " + items[2][1] + " " + filler), (2, items[0][1])], DOCS)
    got = {(r["doc_id"], r["item_id"], r["start_word"]) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 2, 200_000), (2, 0, 0)}


# Lines


def test_lines_against_brute_force(docs, rows):
    some = sorted(d for d, _ in rows)[:80]
    want = brute.repeated_lines([r for r in rows if r[0] in some])
    got = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(docs.filter(F.col("doc_id").isin(some))).collect()}
    assert len(got & want) >= 0.97 * len(want) and want
    assert not got - want or len(got - want) <= 0.02 * len(got)  # another representative where a pair was missed


def test_lines_small(spark):
    base = "a line that is certainly long enough to be compared"
    some = [(1, base + "\nshort\n" + base.upper()), (2, "intro text that nobody else has written\n" + base[:-1] + "x"), (3, "short\nshort"), (4, None), (5, ""), (None, base), (6, base)]
    df = spark.createDataFrame([(*r, 7, "n", "g") for r in some], "doc_id long, text string, lines_removed long, node string, _gone string")
    out = {(r["doc_id"], r["text"]): r["lines_removed"] for r in lines.dedup_lines(df).collect()}
    assert out == {
        (1, base + "\nshort"): 1, (2, "intro text that nobody else has written"): 1, (3, "short\nshort"): 0, (4, None): 0, (5, ""): 0, (None, base): 0, (6, ""): 1,
    }
    assert set(lines.dedup_lines(df).columns) == set(df.columns)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_in_large_blocks(spark):
    """More variants of a line than are verified pair by pair, and a look-up by join instead of broadcast."""
    variants = [(i, f"breaking news from the capital city about item {i:03d} of the long agenda for today") for i in range(60)]
    df = spark.createDataFrame(variants, DOCS)
    before = lines.BROADCAST_BYTES
    got = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(df).collect()}
    lines.BROADCAST_BYTES = 0
    try:
        joined = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(df).collect()}
    finally:
        lines.BROADCAST_BYTES = before
    assert got == joined == brute.repeated_lines(variants)


def test_short_lines_meet_only_if_similar():
    """Unrelated short lines share no band, so that candidates grow with the lines; similar ones do, nearly all."""
    rng = np.random.default_rng(5)
    parts = "th er on an re he in ed nd ha at en tion ing the and that was of to".split()
    line = lambda n: "".join(rng.choice([*parts, " ", ". "], n))[:n]
    alone = [line(n) for n in rng.integers(20, 110, 8000)]
    pairs = [(x, x[:1] + "#" + x[2:]) for x in (line(n) for n in rng.integers(22, 60, 1000))]
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join([*alone, *(x for pair in pairs for x in pair)])])], names=["text"])
    table = pa.Table.from_batches(lines._bands(1)(iter([batch])))
    met = lines._blocks(lines.SIMILARITY)(table)
    near = sum(len(brute.shingles(a) & brute.shingles(b)) >= 0.8 * len(brute.shingles(a) | brute.shingles(b)) for a, b in pairs)
    assert near > 900 and 0.99 * near <= len(met.column("head").unique()) <= 1.02 * len(pairs)
    assert met.num_rows <= 2.05 * len(pairs)


def test_lines_edges(spark):
    df, line = odd(spark)
    out = lines.dedup_lines(df).collect()
    assert len(out) == df.count()
    assert [r["text"] for r in out if r["doc_id"] is None and r["text"]] == [line]


# SimHash


def test_simhash_against_brute_force(spark, docs):
    sigs = {r[0]: np.array([r[k] for k in range(1, 5)], dtype=np.int64).view(np.uint64) for r in simhash.signed(docs).collect()}
    ids = sorted(sigs)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if int(np.bitwise_count(sigs[a] ^ sigs[b]).sum()) <= simhash.DISTANCE]
    out = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    assert set(out) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    found = sum(out[a] == out[b] for a, b in pairs)
    assert pairs and found >= 0.95 * len(pairs)
    root = brute.union_find(pairs, out)
    assert all(root[d] == root[g] for d, g in out.items())  # no group joins what brute force keeps apart


@pytest.mark.parametrize("apart", [20, 30, 36, 40])
def test_simhash_recall_by_distance(spark, apart):
    rng = np.random.default_rng(apart)
    bits = rng.integers(0, 2, (1500, simhash.BITS), dtype=np.uint8)
    near = bits.copy()
    for row in near:
        row[rng.choice(simhash.BITS, apart, replace=False)] ^= 1
    sig = np.packbits(np.stack([bits, near], axis=1).reshape(-1, simhash.BITS), axis=1).copy().view(">u8").astype(np.uint64).view(np.int64)
    df = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(sig)], "doc_id long, s0 long, s1 long, s2 long, s3 long")
    found = {(r["a"], r["b"]) for r in simhash.near_edges(df).collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in found)
    assert len(found) >= 0.9 * 1500, len(found) / 1500
    print(f"recall at {apart} bits: {len(found) / 1500:.3f}")


def signatures(spark, bits):
    sig = np.packbits(bits, axis=1).copy().view(">u8").astype(np.uint64).view(np.int64)
    return spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(sig)], "doc_id long, s0 long, s1 long, s2 long, s3 long")


def test_simhash_unrelated_signatures_give_no_rows(spark, monkeypatch):
    # Texts of one language share bits: each agrees with the language's in seven of ten. Their chance encounters grow with the square of the table, so none may leave its task.
    rng = np.random.default_rng(3)
    bits = (rng.random((6000, simhash.BITS)) < 0.3).astype(np.uint8)
    bits[1:100:2] = bits[:100:2]
    bits[1:100:2, :10] ^= 1
    written, real = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, what: [out := real(df, what), written.append(out.count())][0])
    found = {(r["a"], r["b"]) for r in simhash.near_edges(signatures(spark, bits)).collect()}
    assert found == {(i, i + 1) for i in range(0, 100, 2)}
    assert sum(written) <= 5 * 4 * 50, written  # each pair once a round and slot, and nothing else


@pytest.mark.parametrize("copies", [60, 700])  # searched in one matrix, and node by node
def test_simhash_hot_key(spark, copies):
    # All agree in every bit but 120: one chain of copies, in which only neighbours are near, and strangers.
    rng = np.random.default_rng(copies)
    bits = np.repeat(rng.integers(0, 2, (1, simhash.BITS), dtype=np.uint8), copies + 40, axis=0)
    for i in range(copies):
        bits[i, 136:] = (np.arange(120) < 120 * i // copies) ^ bits[i, 136:]
    bits[copies:, 136:] = rng.integers(0, 2, (40, 120), dtype=np.uint8)
    order = rng.permutation(len(bits))
    bits = bits[order]
    apart = (bits[:, None] != bits[None]).sum(axis=2)
    near = [(a, b) for a, b in np.argwhere(apart <= simhash.DISTANCE).tolist() if a < b]
    found = [(r["a"], r["b"]) for r in simhash.near_edges(signatures(spark, bits)).collect()]
    assert set(found) <= set(near)
    ids = range(len(bits))
    assert brute.union_find(found, ids) == brute.union_find(near, ids)
    sig = np.packbits(bits, axis=1).copy().view(">u8").astype(np.uint64)
    searched = [tuple(sorted(x)) for x in np.stack(simhash._searched(sig, simhash.DISTANCE), axis=1).tolist()]
    assert set(searched) <= set(near) and len(searched) < len(bits)
    assert brute.union_find(searched, ids) == brute.union_find(near, ids)


def test_simhash_near_copies(spark, docs):
    rng = np.random.default_rng(5)
    base = [r["text"] for r in docs.filter("n_chars between 1500 and 4000").orderBy("doc_id").limit(30).collect()]
    some = []
    for i, t in enumerate(base):
        w = t.split(" ")
        for k in rng.choice(len(w), max(1, len(w) // 50), replace=False):
            w[k] = f"changed{k}"
        some += [(2 * i, t), (2 * i + 1, " ".join(w))]
    out = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(some, DOCS)).collect()}
    assert sum(out[2 * i] == out[2 * i + 1] for i in range(len(base))) >= 0.9 * len(base)


def test_simhash_edges(spark):
    df, line = odd(spark)
    copies = spark.createDataFrame([(100 + i, "the same text in a hundred documents of one group, word for word") for i in range(100)], DOCS)
    out = {r["doc_id"]: (r["group_id"], r["keep"]) for r in simhash.near_duplicates(df.select("doc_id", "text").unionAll(copies)).collect()}
    assert None not in out
    assert all(out[100 + i] == (100, i == 0) for i in range(100))
    assert out[2] == (2, True) and out[3] == (3, True) and out[4] == (4, True)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
