"""Page templates, URL filters, packing and licences against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.llm import html, licenses, packing, queries, tokens, urls

# HTML


def page(nav, body, foot):
    return f"<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body><div id=top>{nav}</div><article>{body}</article><footer>{foot}</footer></body></html>"


SITE = [(i, f"https://www.Site.example:8080/p/{i}", page("<ul><li><a href=/>Home</a><li>About us</ul>", f"<h1>Title {i}</h1><p>Paragraph {i} with a <b>bold</b> word.<p>Second {i}.", "All pages end so")) for i in range(5)]
OTHER = [(10, "http://other.example/x", page("Elsewhere", "<p>Only page.</p>", "All pages end so"))]
PAGES = "page_id long, url string, html string"


def test_templates_go_and_the_rest_stays(spark):
    out = {r["page_id"]: r for r in html.page_texts(spark.createDataFrame(SITE + OTHER, PAGES)).collect()}
    for i in range(5):
        assert out[i]["text"] == f"Title {i}\nParagraph {i} with a bold word.\nSecond {i}."
        assert out[i]["deleted"] == 2 and out[i]["host"] == "www.site.example"
    assert out[10]["text"] == "Elsewhere\nOnly page.\nAll pages end so" and out[10]["deleted"] == 0


def test_join_gives_what_the_broadcast_gives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").unionByName(spark.createDataFrame(SITE, PAGES))
    a = sorted(map(tuple, html.page_texts(pages).collect()), key=str)
    assert a == sorted(map(tuple, html.page_texts(pages, broadcast_bytes=-1).collect()), key=str)
    assert sum(r[3] for r in a) >= 10


def test_section_templates_of_large_hosts_go(spark):
    rows = [(i, f"http://big.example/{i}", f"<p>Only on page {i}.</p>" + ("<nav>Home of the section</nav>" if i < 5 else "")) for i in range(1000)]
    out = {r["page_id"]: r for r in html.page_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(out[i]["text"] == f"Only on page {i}." and out[i]["deleted"] == (i < 5) for i in range(1000))


def brute_texts(rows, least=html.LEAST_PAGES, share=html.LEAST_SHARE):
    """Subtrees by their own serialisation instead of hashes, counted in dictionaries."""
    pages = {}
    for k, (_, url, h) in enumerate(rows):
        if h is not None:
            m = re.match(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", (url or "").lower())
            pages[k] = (m.group(1).rstrip(".") if m else None, html.Page(h))
    seen = defaultdict(set)
    roots = defaultdict(set)
    for host, p in pages.values():
        if host and p is not None:
            roots[host].add(p.root)
            for *_, digest in p.elements:
                seen[host, digest].add(p.root)
    out = []
    for k, (pid, url, h) in enumerate(rows):
        if h is None:
            out.append((pid, None))
            continue
        host, p = pages[k]
        out.append((pid, p.text({d for (x, d), r in seen.items() if x == host and len(r) >= max(least, share * len(roots[host]))})[0]))
    return sorted(out, key=str)


def test_pages_table_equals_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert sorted(((r["page_id"], r["text"]) for r in html.page_texts(pages).collect()), key=str) == brute_texts(rows)


def test_html_edges(spark):
    some = [*SITE, SITE[0], (20, None, SITE[0][2]), (21, "no host", SITE[0][2]), (22, SITE[0][1], None), (23, SITE[0][1], ""), (None, SITE[0][1], SITE[1][2]), (24, SITE[0][1], "a < b & c <p>x" + "<div>" * 3000), (25, "http://big.example", "<p>" + "long text " * 100_000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in some], PAGES + ", host long, subtrees string")
    out = html.page_texts(df).collect()
    assert len(out) == len(some)
    by = {r["page_id"]: r for r in out}
    assert by[20]["deleted"] == by[21]["deleted"] == 0 and by[20]["host"] is None
    assert by[22]["text"] is None and by[23]["text"] == "" and by[24]["text"] == "a < b & c\nx"
    assert len(by[25]["text"]) == 999_999
    assert html.page_texts(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "http://copy.example/", SITE[0][2]) for i in range(9)], PAGES)
    assert all("Second 0." in r["text"] for r in html.page_texts(copies).collect())  # a page stored nine times is one page


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a<p>b", "a\nb"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"), ("x<script>if (a<b) '</p>'</script>y", "xy"), ("x<!-- <p>no</p> -->y", "xy"), ("x<!-- open", "x"), ("a&amp;b&lt;c", "a&b<c"),
        ("<b>a</b>b <i>c</i>", "ab c"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("</p>a</div>", "a"), ('<p title="a > b">x', "x"), ("<p title='unclosed>x</p><p>y", "y"), ("5 < 6 and 7 > 6", "5 < 6 and 7 > 6"), ("<", "<"), ("", ""),
    ],
)
def test_lenient_reading(source, text):
    if "unclosed" in source:
        html.Page(source)  # any text, but no failure
    else:
        assert html.Page(source).text()[0] == text


# URLs


def test_url_filter_on_the_table_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = urls.url_filter(pages, urls.listed_keys(spark)).collect()
    for r in out:
        h = re.match(r"\w+://([^/:?#]+)", r["url"]).group(1)
        want = [k for k in urls.LISTED if h == k or h.endswith("." + k)]
        assert (r["listed"], r["matched"]) == (bool(want), want[0] if want else None)
    assert {r["listed"] for r in out} == {True, False}


def test_cascade_is_exact(spark):
    rng = np.random.default_rng(1)
    hosts = [f"h{i}.example.com" for i in range(4000)]
    listed = [hosts[i] for i in rng.choice(4000, 700, replace=False)] + ["never-seen.example.org", "h1.example.com/a/page", None, " "]
    pages = spark.createDataFrame([(i, f"HTTPS://user@www.{h}:443/a/page/?q=1#f", "k", True) for i, h in enumerate(hosts)], "page_id long, url string, key string, listed boolean")
    keys = spark.createDataFrame([(k, 1) for k in listed], "key string, page_id int")
    out = urls.url_filter(pages, keys).collect()
    assert {hosts[r["page_id"]] for r in out if r["listed"]} == set(listed) & set(hosts)
    assert all(r["matched"] == (hosts[r["page_id"]] if r["listed"] else None) for r in out)
    joined = urls.url_filter(pages, keys, most_bytes=0).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, joined), key=str)


def test_url_edges(spark):
    some = [(1, None), (2, ""), (3, "nothing"), (4, "http://spam.example/"), (4, "http://spam.example/"), (None, "//a.spam.example./x"), (5, "http://good.example/bad/page/"), (6, "http://good.example/bad"), (7, "http://" + "a." * 120 + "spam.example/" + "x" * 100_000)]
    df = spark.createDataFrame(some, "page_id long, url string")
    keys = spark.createDataFrame([("spam.example",), ("Spam.Example",), ("good.example/bad/page",)], "key string")
    out = [(r["page_id"], r["listed"], r["matched"]) for r in urls.url_filter(df, keys).collect()]
    assert sorted(out, key=str) == sorted([(1, False, None), (2, False, None), (3, False, None), (4, True, "spam.example"), (4, True, "spam.example"), (None, True, "spam.example"), (5, True, "good.example/bad/page"), (6, False, None), (7, True, "spam.example")], key=str)
    assert urls.url_filter(df.limit(0), keys).count() == 0
    assert not any(r["listed"] for r in urls.url_filter(df, keys.limit(0)).collect())


# Packing


def check_bins(out, tokens, capacity):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        bins[r["bin_id"]].append((r["at"], r["n_tokens"], r["item"]))
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
    for b in bins.values():
        b.sort()
        assert [i for *_, i in b] == list(range(len(b)))
        assert [a for a, *_ in b] == np.concatenate([[0], np.cumsum([n for _, n, _ in b])[:-1]]).astype(int).tolist()
        assert sum(n for _, n, _ in b) <= capacity
    for d, n in tokens.items():
        own = sorted(pieces.pop(d, []))
        assert sum(k for _, k in own) == n and len(own) == -(-n // capacity)
        assert [s for s, _ in own] == [i * capacity for i in range(len(own))]
    assert not pieces
    return len(bins)


def test_packing_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4)
    tokens = {r["doc_id"]: len(re.findall(r"\w+|[^\w\s]", r["text"])) for r in docs.collect()}
    for group_bins in (packing.GROUP_BINS, 4):
        n = check_bins(packing.packed(docs, group_bins=group_bins).collect(), tokens, packing.CAPACITY)
        assert n <= 1.06 * math.ceil(sum(tokens.values()) / packing.CAPACITY) + 2


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(2)
    for capacity in (10, 100):
        sizes = rng.integers(1, capacity + 1, 300)
        room: list[int] = []
        want = np.zeros(300, int)
        for i in np.argsort(-sizes, kind="stable"):
            fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            if fits:
                least = min(r for r, _ in fits)
                b = next(b for r, b in fits if r == least)
                room[b] -= sizes[i]
            else:
                b = len(room)
                room.append(capacity - sizes[i])
            want[i] = b
        got = packing.best_fit(sizes, capacity)
        assert len(set(got.tolist())) == len(set(want.tolist()))
        assert max(np.bincount(got, weights=sizes)) <= capacity


def test_packing_edges(spark):
    some = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " \n"), (None, "x y"), (5, "w " * 25_000), (6, "z"), (7, "w " * 10)]
    df = spark.createDataFrame([(*r, 1, 2) for r in some], "doc_id long, text string, n long, slot long")
    tokens = Counter({5: 25_000, 6: 1, 7: 10})
    out = packing.packed(df, 10).collect()
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == tokens + Counter({1: 6})
    assert max(Counter({b: sum(r["n_tokens"] for r in out if r["bin_id"] == b) for b in {r["bin_id"] for r in out}}).values()) <= 10
    assert packing.packed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, 0)


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_token_counts_equal_the_tokenizer(spark, sf_dir, monkeypatch, name):
    path = f"/opt/tokenizers/{name}.tiktoken"
    with open(path, "rb") as file:
        ranks = file.read()
    counter = tokens.Counter(ranks)
    rng = np.random.default_rng(8)
    alphabet = list("aZé日١5 '\n\t\u00a0\u3000.-_sdmtlvre'") + ["  ", "'ll", "'re", " 's", "\n ", " \n", "ſ", "Ⅷ", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet, k)) for k in rng.integers(0, 60, 3000)]
    texts += [None, "", " ", "it's 'tis they'll'll we've'", "naïve café straße", "x" * 3000, *(r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    want = [len(counter.model.encode_ordinary(t or "")) for t in texts]
    assert counter(pa.array(texts)).tolist() == want
    monkeypatch.setattr(tokens, "SLICE", 100)
    monkeypatch.setattr(tokens, "KEPT", 50)
    assert counter(pa.array(texts)).tolist() == want


def test_packing_with_a_tokenizer(spark, sf_dir):
    df = spark.createDataFrame([(1, "Hello world, this is a test."), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["n"] for r in packing.token_counts(df, tokenizer="/opt/tokenizers/byte_bpe_50k.tiktoken").collect()} == {1: 8}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = {r["doc_id"]: r["n"] for r in packing.token_counts(docs, tokenizer=packing.TOKENIZER).collect()}
    check_bins(queries.op6_packing(spark, sf_dir).collect(), sizes, packing.CAPACITY)


def test_packing_ends_at_one_root(spark):
    """Bins that can't join one another are finished, whatever their number, and small ones still find their place."""
    sizes = [6] * 300 + [4] * 40 + [3] * 7
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(16)
    n = check_bins(packing.packed(df, 10, group_bins=5).collect(), dict(enumerate(sizes)), 10)
    assert n == 300  # every four and three lies beside a six


# Licences


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string")


def test_licences_of_files_and_directories(spark):
    code = "def f(x):\n    return x + 1\n" * 5
    rows = [
        (1, "a/LICENSE", "MIT License\n\nPermission is granted to deal without restriction."),
        (2, "a/b/c/x.py", code), (3, "a/b/y.py", "# SPDX-License-Identifier: Apache-2.0\n" + code), (4, "a/b/d/COPYING", "This program is licensed under the\nGNU General Public License version 3"),
        (5, "a/b/d/e/z.py", code), (6, "q/z.py", code), (7, "ab/x.py", code), (8, "a/q.txt", "My driver license was renewed under the new rules that everybody in the city complained about"),
        (9, "root.py", code),
    ]
    out = {r["doc_id"]: (r["license"], r["origin"], r["from_path"]) for r in licenses.licenses(files(spark, rows)).collect()}
    assert out == {
        1: ("MIT", "file", None), 2: ("MIT", "inherited", "a/LICENSE"), 3: ("Apache-2.0", "header", None), 4: ("GPL-3.0", "file", None), 5: ("GPL-3.0", "inherited", "a/b/d/COPYING"),
        6: (None, "none", None), 7: (None, "none", None), 8: ("MIT", "inherited", "a/LICENSE"), 9: (None, "none", None),
    }
    rooted = licenses.licenses(files(spark, [*rows, (10, "LICENSE", "Licensed under CC BY-NC 4.0.")])).collect()
    assert {r["doc_id"]: r["license"] for r in rooted if r["doc_id"] in (6, 7, 9, 2)} == {6: "CC-BY-NC-4.0", 7: "CC-BY-NC-4.0", 9: "CC-BY-NC-4.0", 2: "MIT"}


def test_licence_cosine_equals_the_formula(spark):
    rows = [(1, "a", "Released under the MIT License."), (2, "b", "some text\nLicensed under the Apache License, Version 2.0.\nmore"), (3, "c", "nothing here"), (4, "d", None)]
    df = files(spark, rows)
    matcher = licenses.fit(df)
    texts = [re.findall(r"[a-z0-9]+", (t or "").lower()) for *_, t in rows]
    vocabulary = {w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()}
    idf = lambda w: math.log(5 / ((sum(w in t for t in texts) if w in vocabulary else 0) + 1)) + 1

    def cosine(a, b):
        x, y = Counter(a), Counter(b)
        dot = sum(x[w] * y[w] * idf(w) ** 2 for w in x)
        return dot / math.sqrt(sum((n * idf(w)) ** 2 for w, n in x.items())) / math.sqrt(sum((n * idf(w)) ** 2 for w, n in y.items()))

    for probe in ("released under the mit license", "an unknown word and license", "all rights reserved"):
        want = max(cosine(probe.split(), t.split()) for ts in licenses.TEMPLATES.values() for t in ts)
        assert matcher.match(licenses._words([probe])[0])[0] == pytest.approx(want, abs=1e-5)


def test_licences_in_the_documents(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r["doc_id"]: r for r in licenses.licenses(docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))).collect()}
    known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary"}
    n = 0
    for r in docs.collect():
        want = {v for k, v in known.items() if k in r["text"].split("\n")}
        n += bool(want)
        if want:
            assert out[r["doc_id"]]["license"] in want
        else:
            assert out[r["doc_id"]]["origin"] in ("none", "inherited")
    assert n > 20


def test_notices_are_found_at_every_size(spark):
    common = ["This repository holds tools of Foobar and the like.", "Another repository, of Foobar too."]
    notice = "This Foobar repository is licensed under the Apache License, Version 2.0."
    df = spark.range(6000).select("id", F.concat_ws("", F.lit("x/"), "id").alias("path"), F.when(F.col("id") == 0, notice).when(F.col("id") % 2 == 0, common[0]).otherwise(common[1]).alias("text")).withColumnRenamed("id", "doc_id")
    for size in (licenses.BROADCAST_BYTES, -1):
        out = licenses.licenses(df, broadcast_bytes=size).filter("doc_id = 0").first()
        n, dfs = 6000, Counter({"repository": 6000, "foobar": 6000, "of": 5999, "this": 3000, "holds": 2999, "tools": 2999, "and": 2999, "like": 2999, "the": 3000, "another": 3000, "too": 3000, "is": 1, "licensed": 1, "under": 1, "apache": 1, "license": 1, "version": 1, "2": 1, "0": 1})
        idf = lambda w: math.log((n + 1) / (dfs[w] + 1)) + 1
        vector = lambda ws: {w: c * idf(w) for w, c in Counter(ws).items()}
        x = vector(re.findall(r"[a-z0-9]+", notice.lower()))
        y = vector(licenses.TEMPLATES["Apache-2.0"][0].split())
        want = sum(x[w] * y.get(w, 0) for w in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        assert (out["license"], out["origin"]) == ("Apache-2.0", "file") and out["cosine"] == pytest.approx(want, abs=1e-5)


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_whole_licence_texts_are_files(spark):
    out = licenses.licenses(files(spark, [(1, "a/about", MIT), (2, "a/b/x.py", "x = 1"), (3, "c/x.py", "MIT License\n\n" + "x = 1\n" * 20)])).collect()
    assert {r["doc_id"]: (r["license"], r["origin"]) for r in out} == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("MIT", "header")}


def test_documents_inherit_nothing(spark, tmp_path):
    rows = [(1, "A.\nAll rights reserved.", "en", "web"), (2, "no licence here", "en", "web"), (None, "MIT License", None, "web"), (3, "nor here", None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["license"] for r in queries.op10_licenses(spark, str(tmp_path)).collect()} == {1: "Proprietary", 2: None, None: "MIT", 3: None}


def test_documents_with_paths_inherit_along_them(spark, tmp_path):
    rows = [(1, "A.\nAll rights reserved.", "a/LICENSE"), (2, "no licence here", "a/b/x"), (3, "nor here", "c/x"), (4, "MIT License", "c/d/y")]
    spark.createDataFrame(rows, "doc_id long, text string, path string").write.parquet(f"{tmp_path}/own/documents.parquet")
    out = {r["doc_id"]: (r["license"], r["origin"], r["from_path"]) for r in queries.op10_licenses(spark, f"{tmp_path}/own").collect()}
    assert out[2] == ("Proprietary", "inherited", "a/LICENSE") and out[3] == (None, "none", None)
    # Without paths rows of one doc_id don't inherit from each other.
    spark.createDataFrame([(1, "A.\nAll rights reserved."), (1, "no licence here")], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    bare = queries.op10_licenses(spark, f"{tmp_path}/none").collect()
    assert sorted((r["license"] or "", r["origin"]) for r in bare) == [("", "none"), ("Proprietary", "file")]


def test_licence_edges(spark):
    rows = [(1, None, "MIT License"), (2, "a/LICENSE", None), (3, "a/x", ""), (None, "a/y", "all rights reserved"), (4, "a/y", "x " * 200_000), (5, "", "MIT License"), (3, "a/x", ""), (6, "b//c/", "z")]
    df = files(spark, rows).withColumn("own", F.lit(1)).withColumn("dir", F.lit("q")).withColumn("license", F.lit(None).cast("string"))
    out = licenses.licenses(df).collect()
    assert len(out) == len(rows)
    assert {(r["doc_id"], r["license"]) for r in out} >= {(1, "MIT"), (None, "Proprietary"), (5, "MIT")}
    assert licenses.licenses(df.limit(0)).count() == 0


def brute_licences(rows, similarity=licenses.SIMILARITY):
    """Each text's best notice by cosines over dictionaries: (licence, cosine) or None."""
    word = lambda t: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", t.lower())
    n, df = len(rows), Counter(w for *_, t in rows for w in set(word(t or "")))
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1

    def cosine(a, b):
        dot = sum(a[w] * b[w] * idf(w) ** 2 for w in a)
        return dot / math.sqrt(sum((c * idf(w)) ** 2 for w, c in a.items()) * sum((c * idf(w)) ** 2 for w, c in b.items())) if a else 0.0

    counted = lambda t: Counter({w.partition(":")[0]: int(w.partition(":")[2] or 1) for w in t.split(" ")})
    short = [(k, Counter(word(t))) for k, ts in licenses.TEMPLATES.items() for t in ts]
    full = [(k, counted(t)) for k, t in licenses.TEXTS.items()] + [(k, Counter(word(" ".join(ts)))) for k, ts in licenses.MADE.items()]
    out = {}
    for d, _, t in rows:
        t = t or ""
        hint = re.compile(licenses.HINT, re.I)
        if not hint.search(t):
            out[d] = None
            continue
        if len(word(t)) >= licenses.LEAST_TEXT:
            c, k = max((round(cosine(Counter(word(t)), b), 6), k) for k, b in full)
            if c >= licenses.WHOLE_SIMILARITY:
                out[d] = (k, c)
                continue
        lines, best = t.split("\n"), None
        block = [sum(not x.strip() for x in lines[: i + 1]) for i in range(len(lines))]
        for i, x in enumerate(lines):
            if hint.search(x):
                around = [y for j, y in enumerate(lines) if block[j] == block[i] and y.strip()] if x.strip() else [x]
                for y in (x, x + " " + lines[i + 1] if i + 1 < len(lines) and lines[i + 1].strip() else x, " ".join(around)):
                    top = max((round(cosine(Counter(word(y)), b), 6) for _, b in short), default=0)
                    names = [k for k, b in short if round(cosine(Counter(word(y)), b), 6) == top]
                    if top >= similarity and (best is None or top > best[1]):
                        best = (min(names), top)
        out[d] = best
    return out


def test_licences_of_the_table_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    rows = [(r["doc_id"], r["path"], r["text"]) for r in docs.collect()]
    want = brute_licences(rows)
    own = {r["doc_id"]: r for r in licenses.licenses(docs).filter("origin <> 'inherited'").collect()}
    assert sum(w is not None for w in want.values()) > 3
    for d, w in want.items():
        if w:
            assert own[d]["cosine"] == pytest.approx(w[1], abs=2e-6), d
    assert {d for d, w in want.items() if w} == {d for d, r in own.items() if r["license"]}


def test_full_texts_and_a_tree_of_paths(spark):
    rng = np.random.default_rng(3)
    full = lambda name: " ".join(w.partition(":")[0] for w in licenses.TEXTS[name].split(" ") for _ in range(int(w.partition(":")[2] or 1)))
    shuffled = lambda name: "\n".join(" ".join(rng.permutation(full(name).split(" "))[k::40]) for k in range(40))
    parts = ["a", "b", "c"]
    dirs = sorted({"/".join(rng.choice(parts, k)) for k in rng.integers(0, 5, 60)})
    held = {d: name for d, name in zip(rng.permutation(dirs)[:8].tolist(), rng.permutation(list(licenses.TEXTS)).tolist())}
    rows = [(i, f"{d}/f.py".lstrip("/"), "x = 1") for i, d in enumerate(dirs)] + [(1000 + i, f"{d}/about.txt".lstrip("/"), shuffled(name)) for i, (d, name) in enumerate(held.items())]
    out = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.licenses(files(spark, rows)).collect()}
    for i, d in enumerate(dirs):
        ups = ["/".join(d.split("/")[:k]) if k else "" for k in range(len(d.split("/")), -1, -1)] if d else [""]
        near = next((u for u in ups if u in held), None)
        assert out[i] == ((held[near], "inherited") if near is not None else (None, "none")), d
    assert all(out[1000 + i] == (name, "file") for i, name in enumerate(held.values()))
