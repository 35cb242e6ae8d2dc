"""Exact substring dedup against brute force."""

import numpy as np
from llm_help import documents

from trackscore.llm import suffixes


def brute(rows, length):
    first, out = {}, []
    for i, t in rows:
        body = (t or "").encode()
        for p in range(len(body) - length + 1):
            if i is not None:
                w = body[p:p + length]
                first[w] = min(i, first.get(w, i))
    for i, t in rows:
        body = (t or "").encode()
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - length + 1):
            if i is not None and first[body[p:p + length]] < i:
                gone[p:p + length] = True
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((i, len(body), int(gone.sum()), spans, None if t is None else kept))
    return out


def test_agrees_with_brute_force_in_any_chunking(spark, awkward):
    rows = awkward + [(500, "\0" * 200), (501, "z" + "\0" * 120), (502, "café " * 20)]
    docs = documents(spark, rows)
    want = sorted(brute(rows, 50), key=repr)
    for chunk in (2_000_000, 4_000):
        got = suffixes.remove_repeats(docs, chunk_bytes=chunk, carry=["source"]).collect()
        assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), None if r.text is None else bytes(r.text))
                       for r in got], key=repr) == want


def test_levels_at_least_halve_and_keep_the_smallest_document():
    rng = np.random.default_rng(3)
    levels, known = suffixes.SuffixLevels(), {}
    for batch in range(20):
        strings = np.unique(rng.integers(0, 60, rng.integers(1, 30)).astype("S2"))
        want = [known.get(s, np.iinfo(np.int64).max) for s in strings.tolist()]
        assert levels.scan(strings).tolist() == want
        levels.add(strings, np.full(len(strings), batch))
        for s in strings.tolist():
            known.setdefault(s, batch)
        sizes = [len(s) for s, _ in levels.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_empty_table(spark, awkward):
    assert suffixes.remove_repeats(documents(spark, awkward).where("false")).collect() == []
