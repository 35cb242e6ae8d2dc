"""Substring dedup on token windows against brute force."""

from llm_help import documents, words_of

from trackscore.llm import windows


def brute(rows, width):
    """Removed word positions of each row, in the order of ``rows``."""
    first = {}
    cut = [(i, words_of(t)) for i, t in rows]
    for i, words in cut:
        if i is not None:
            for p in range(len(words) - width + 1):
                w = tuple(words[p:p + width])
                first[w] = min(i, first.get(w, i))
    out = []
    for i, words in cut:
        gone = set()
        if i is not None:
            for p in range(len(words) - width + 1):
                if first[tuple(words[p:p + width])] < i:
                    gone |= set(range(p, p + width))
        out.append((i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_agrees_with_brute_force_in_any_chunking(spark, awkward):
    docs = documents(spark, awkward)
    want = order(brute(awkward, 13))
    for chunk, bucket in ((4_000_000, 1_000_000), (3_000, 200)):
        got = windows.remove_repeats(docs, chunk_bytes=chunk, bucket_prints=bucket).collect()
        assert order([(r.doc_id, r.n_words, r.n_removed, " ".join(words_of(r.text))) for r in got]) == want


def test_text_without_repeats_is_unchanged_and_columns_travel(spark, awkward):
    docs = documents(spark, awkward)
    got = windows.remove_repeats(docs, carry=["lang", "_id"], chunk_bytes=3_000).collect()
    texts = {}
    for i, t in awkward:
        texts.setdefault(i, set()).add(t)
    assert all(r.lang == "en" and r._id == -1 for r in got)
    assert all(r.text in texts[r.doc_id] for r in got if not r.n_removed)
    assert any(r.n_removed for r in got)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_other_widths_and_empty_table(spark, awkward):
    docs = documents(spark, awkward)
    got = windows.remove_repeats(docs, width=3).collect()
    assert order([(r.doc_id, r.n_words, r.n_removed, " ".join(words_of(r.text))) for r in got]) == order(brute(awkward, 3))
    assert windows.remove_repeats(docs.where("false")).collect() == []
