"""Plain Python versions of the operators, written for clarity; the tests hold the operators against them."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(text):
    return re.findall(r"[^ \t\n\r\f\v]+", text or "")


def plain_words(text):
    """Lower-case runs of letters and digits; other non-ASCII characters belong to words."""
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def repetition(text, lengths):
    w = words(text)
    total = sum(map(len, w))
    out = {"word_chars": total}
    for n in lengths:
        grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        covered = set()
        for i in range(len(w) - n + 1):
            if grams[tuple(w[i : i + n])] > 1:
                covered |= set(range(i, i + n))
        out[f"dup_{n}gram"] = round(sum(len(w[i]) for i in covered) / total, 6) if total else 0.0
    lines = [x for x in (text or "").split("\n") if x]
    seen, chars = Counter(lines), sum(map(len, lines))
    out["line_chars"] = chars
    out["dup_lines"] = round(sum(len(x) for x in lines if seen[x] > 1) / chars, 6) if chars else 0.0
    return out


def repeats(docs, length):
    """docs: (doc_id, text). Spans of words covered by stretches that a document of another id has."""
    where = defaultdict(set)
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].add(d)
    out = set()
    by_doc = defaultdict(list)
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - length + 1):
            others = where[tuple(w[i : i + length])] - {d}
            if others:
                by_doc[d].append((i, i + length, min(others)))
    for d, found in by_doc.items():
        found.sort()
        spans = []
        for s, e, o in found:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
                spans[-1][2] = min(spans[-1][2], o)
            else:
                spans.append([s, e, o])
        out |= {(d, s, e, e - s, o) for s, e, o in spans}
    return out


def contaminated(docs, tests, phrase=13, share=0.8, slop=3, least=8):
    import math

    best = {}
    for d, t in docs:
        if d is None:
            continue
        w = plain_words(t)
        place = defaultdict(list)
        for i, x in enumerate(w):
            place[x].append(i)
        for item, q in tests:
            terms = plain_words(q)
            m = len(terms)
            if item is None or not m:
                continue
            n, exact = min(phrase, m), None
            for o in range(m):
                for i in place.get(terms[o], ()):
                    if o and i and w[i - 1] == terms[o - 1]:
                        continue
                    k = 0
                    while o + k < m and i + k < len(w) and w[i + k] == terms[o + k]:
                        k += 1
                    if k >= n and (exact is None or (k, -i) > exact):
                        exact = (k, -i)
            if exact:
                found = (True, exact[0], exact[1])
            elif m < least:
                found = None
            else:
                need, found = math.ceil(share * m - 1e-9), None
                if sum(x in place for x in terms) < need:
                    continue
                starts = {i - o + s for o in range(m) for i in place.get(terms[o], ()) for s in range(-slop, slop + 1)}
                for start in starts:
                    k = sum(any(abs(i - (start + o)) <= slop for i in place.get(terms[o], ())) for o in range(m))
                    if k >= need and (found is None or (k, -max(0, start)) > found[1:]):
                        found = (False, k, -max(0, start))
            if found and (*found, m) > best.get((d, item), (False, 0, 1, 0)):
                best[(d, item)] = (*found, m)
    return {(d, i, "short" if n < least else "exact" if e else "near", m) for (d, i), (e, m, _, n) in best.items()}


def shingles(line, n=5):
    return {line[i : i + n] for i in range(len(line) - n + 1)}


def repeated_lines(docs, similarity=0.8, least=20):
    """docs: (doc_id, text). (doc_id, line_no) of lines that go."""
    first = {}
    at = defaultdict(list)
    for d, t in docs:
        if d is None:
            continue
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                at[x.lower()].append((d, k))
    lines = sorted(at)
    sets = {x: shingles(x) for x in lines}
    pairs, by_size = [], sorted(lines, key=lambda x: len(sets[x]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            if len(sets[a]) < similarity * len(sets[b]) - 1e-9:
                break
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                pairs.append((a, b))
    root = union_find(pairs, lines)
    for x in lines:
        first[root[x]] = min([first.get(root[x], min(at[x])), *at[x]])
    return {(d, k) for x in lines for d, k in at[x] if (d, k) != first[root[x]]}


def kneser_ney(texts, order, discount):
    """A function (context, char) -> probability of an interpolated Kneser-Ney model over already normalised texts."""
    grams = Counter()
    for t in texts:
        s = "\x01" * (order - 1) + t
        grams.update(s[i : i + order] for i in range(len(s) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    totals = {k: Counter() for k in counts}
    types = {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            totals[k][g[:-1]] += n
            types[k][g[:-1]] += 1

    def p(gram, alphabet):
        k = len(gram)
        if k == 0:
            return 1 / (alphabet + 1)
        lower = p(gram[1:], alphabet)
        total = totals[k][gram[:-1]]
        if not total:
            return lower
        return max(counts[k][gram] - discount, 0) / total + discount * types[k][gram[:-1]] / total * lower

    return p, len(counts[1])
