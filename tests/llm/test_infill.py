"""Infilling forms against a plain rearrangement, and exact round trips."""

import hashlib
import random
import re

import pytest
from llm_help import documents
from trackscore.llm import infill


def brute(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or any(m in text for m in infill.MARKS):
        return doc_id, len(lines), "plain", None, None, text
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return doc_id, len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def awkward_lines():
    rng = random.Random(3)
    bits = ["a", "é", "漢", "\n", "<", "P", ">", "<P", "S>", "M>", "\r\n", " "]
    texts = ["".join(rng.choice([*bits, "<S>"] if i % 9 == 0 else bits) for _ in range(rng.randint(1, 60))) for i in range(300)]
    return [(i, t) for i, t in enumerate([*texts, "\n", "\n\n\n", "one line", "<P", "<P>", "", None])]


def check(spark, rows):
    moved = infill.transform(documents(spark, rows), carry=["lang", "kept"])
    got = infill.restore(moved).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted([tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in got], key=key) \
        == sorted([brute(i, t) for i, t in rows], key=key)
    texts = lambda rows: sorted((i is None, i or 0, t or "") for i, t in rows)
    assert texts([(r.doc_id, r.restored) for r in got]) == texts(rows)
    assert {(r.lang, bytes(r.kept)) for r in got} == {("en", b"k")}
    return got


def test_agrees_with_plain_rearrangement_and_restores(spark, awkward):
    got = check(spark, [*awkward_lines(), *awkward])
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_any_steps_and_slices_give_the_same():
    import pyarrow as pa

    rows = [t or "" for _, t in awkward_lines()]
    h = [[random.Random(i).randrange(2**32) for i in range(k, k + len(rows))] for k in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows), *map(pa.array, h)],
                                       names=["_id", "_text", *(f"_h{i}" for i in range(4))])
    want = pa.Table.from_batches(infill._mover(100, 50)([batch])).to_pylist()
    slice_, defaults = infill.SLICE, infill.steps.__defaults__
    try:
        infill.SLICE, infill.steps.__defaults__ = 7, (50,)
        got = pa.Table.from_batches(infill._mover(100, 50)([batch])).to_pylist()
        outs = pa.RecordBatch.from_pylist([{"form": r["_form"], "output": r["_output"]} for r in got])
        back = pa.Table.from_batches(infill._restorer([outs])).column("restored").to_pylist()
    finally:
        infill.SLICE, infill.steps.__defaults__ = slice_, defaults
    assert got == want and back == rows


def test_shares_of_forms(spark):
    docs = documents(spark, [(i, "a\nb\nc\n") for i in range(400)])
    count = lambda **kw: {r.form: r["count"] for r in infill.transform(docs, **kw).groupBy("form").count().collect()}
    assert count(rate=0) == {"plain": 400} and count(spm=0) == {"psm": 400}
    mixed = count(rate=70)
    assert 60 < mixed["plain"] < 180 and mixed["psm"] > 80 and mixed["spm"] > 80


def test_very_long_text_and_empty_table(spark):
    long = "".join(f"line {i} é\n" for i in range(400_000))
    check(spark, [(1, long), (2, "short\n")])
    assert infill.restore(infill.transform(documents(spark, [(1, "x")]).where("false"))).collect() == []


def test_an_output_without_marks_is_refused(spark):
    with pytest.raises(Exception, match="lacks a mark"):
        infill.restore(spark.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")).collect()
