"""Spans of slices and of parts of long texts, against regular expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from trawl.llm import arrowtext


@pytest.mark.parametrize(("scan", "block"), [(7, 5), (64, 1 << 17), (1 << 20, 1 << 17)])
def test_spans_and_parts(monkeypatch, scan, block):
    monkeypatch.setattr(arrowtext, "_SCAN", scan)
    monkeypatch.setattr(arrowtext, "BLOCK", block)
    monkeypatch.setattr(arrowtext, "_powers", {})
    rng = np.random.default_rng(0)
    for _ in range(100):
        texts = ["".join(rng.choice(list("ab é\n漢,"), n)) for n in rng.integers(0, 40, rng.integers(1, 6))]
        words = [re.findall(r"[^ \n]+", t) for t in texts]
        data, offsets = arrowtext.buffers(pa.array(texts))
        p = arrowtext.Pieces(data, offsets, arrowtext.SPACE)
        found = [data.tobytes()[a:b].decode() for a, b in zip(p.starts, p.ends)]
        assert found == [w for ws in words for w in ws] and p.counts.tolist() == [len(ws) for ws in words]
        assert p.chars().tolist() == [len(w) for w in found]
        known = dict(zip(found, p.hashes.tolist()))
        assert [known[w] for w in found] == p.hashes.tolist() and len(set(known.values())) == len(known)
        seen, ended = [[] for _ in texts], [0] * len(texts)
        for i, j, q, first, whole in arrowtext.parts(pa.array(texts), arrowtext.SPACE, most=9, overlap=2):
            own = [q.data.tobytes()[a:b].decode() for a, b in zip(q.starts, q.ends)]
            for r, n, end in zip(range(i, j), q.counts, np.cumsum(q.counts)):
                assert words[r][first : first + n] == own[end - n : end]
                seen[r].append((first, int(n)))
                ended[r] += whole
        assert ended == [1] * len(texts)
        for ws, parts in zip(words, seen):
            assert max(f + n for f, n in parts) == len(ws) and all(g == f + n - 2 for (f, n), (g, _) in zip(parts, parts[1:]))
