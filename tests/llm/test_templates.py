"""Benchmark leaks, verbatim and with other slot values."""

import random

from llm_help import documents
from pyspark.sql import functions as F

from trackscore.llm import templates

ITEM = ("Yesterday Anna Berg bought 12 kg of rice and 30 kg of beans for 45.50 euros, "
        "then Carl Lund carried 12 kg of it home to Anna Berg over 3 km of road.")
SWAPPED = ("Yesterday Mira Holt bought 7 kg of rice and 99 kg of beans for 1,200 euros, "
           "then Otto Quist carried 7 kg of it home to Mira Holt over 8 miles of road.")
# No stretch of 13 tokens is filled consistently: a value of the item that comes again stands for another one.
DENSE = "put 12 kg of rice and 12 kg of beans then 12 kg of salt or 12 kg of figs in"
BROKEN = "put 12 kg of rice and 13 kg of beans then 14 kg of salt or 15 kg of figs in"
LATER = ("Yesterday Mira Holt bought 7 kg of rice and 99 kg of beans for 1,200 euros, "
         "then Otto Quist carried 6 kg of it home to Olga Finn over 8 miles of road.")
SHORT = "the small grey cat sat under nine old red trees"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def test_tokens_and_placeholders(spark):
    row = spark.createDataFrame([("Then John Smith paid $4.50 for 7km <b> of 3 miles. Bob left",)], "t string").select(
        templates.template_tokens(F.col("t")).alias("a"), templates.template_tokens(F.col("t"), True).alias("b")).first()
    assert row.a == ["then", "<p>", "<p>", "paid", "<n>", "for", "<n>", "<u>", "b", "of", "<n>", "<u>", "bob", "left"]
    assert row.b[1:5] == ["<p:john>", "<p:smith>", "paid", "<n:$4.50>"] and len(row.a) == len(row.b)


def test_verbatim_and_reparameterised_items_are_found(spark, awkward, prose):
    rows = awkward + [(900, f"{prose(40)} {ITEM} {prose(40)}"), (901, SWAPPED), (902, f"{prose(25)}. {SWAPPED}\n{prose(5)}"),
                      (904, f"{prose(9)} {SHORT} {prose(9)}"), (905, ITEM.upper()), (906, f"{prose(4000)} {ITEM}"), (None, ITEM)]
    docs = documents(spark, rows)
    bench = items(spark, [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, "too short"), (6, prose(50)), (1, ITEM)])
    leaks = templates.find_leaks(docs, bench).collect()
    found = {(r.doc_id, r.item_id) for r in leaks}
    assert found == {(900, 1), (901, 1), (902, 1), (904, 2), (905, 1), (906, 1), (None, 1)}
    assert {r.doc_id: r.exact for r in leaks if r.doc_id in (900, 901)} == {900: True, 901: False}


def test_slots_must_be_filled_consistently(spark, prose):
    docs = documents(spark, [(1, SWAPPED), (2, BROKEN), (3, DENSE.replace("12", "9"))])
    leaks = templates.find_leaks(docs, items(spark, [(1, ITEM), (2, DENSE)])).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(1, 1), (3, 2)}


def test_copied_stretch_of_an_inconsistent_run(spark, prose):
    """A copy that changes one repeated number at the end; the run goes on over it."""
    changed = ITEM.replace("carried 12 kg", "carried 13 kg")
    docs = documents(spark, [(1, f"{prose(9)} {changed} {prose(9)}"), (2, LATER)])
    leaks = templates.find_leaks(docs, items(spark, [(1, ITEM)])).collect()
    assert {r.doc_id for r in leaks} == {1, 2} and all(r.n_tokens >= templates.LEAK for r in leaks)
    assert any(r.exact for r in leaks if r.doc_id == 1) and not any(r.exact for r in leaks if r.doc_id == 2)


def brute_stretches(d, i):
    """Maximal stretches (start, length) whose slots are filled one to one."""
    def fine(a, z):
        pairs = {(d[k], i[k]) for k in range(a, z) if i[k].startswith("<")}
        return len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})

    n = len(d)
    good = [(a, z) for a in range(n) for z in range(a + 1, n + 1) if fine(a, z)]
    return {(a, z - a) for a, z in good if not any((b, y) != (a, z) and b <= a and z <= y for b, y in good)}


def test_consistent_stretches_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for n in range(60):
        kinds = [rng.random() < 0.6 for _ in range(rng.randint(1, 14))]
        rows.append((n, [f"<n:{rng.randint(1, 3)}>" if k else "w" for k in kinds], [f"<n:{rng.randint(1, 3)}>" if k else "w" for k in kinds]))
    got = {}
    for r in templates.consistent_stretches(spark.createDataFrame(rows, "id int, d array<string>, i array<string>")).collect():
        got.setdefault(r.id, set()).add((r.leak.at, r.leak.n))
        part = slice(r.leak.at, r.leak.at + r.leak.n)
        assert r.leak.exact == (r.d[part] == r.i[part])
    assert got == {n: brute_stretches(d, i) for n, d, i in rows}


def test_short_items_and_other_case(spark, prose):
    rows = [(1, f"{prose(9)} five small words Stand here {prose(9)}"), (2, "FIVE SMALL WORDS STAND HERE"), (3, "five small words stand there"),
            (4, f"{prose(3)}. {ITEM.lower()} {prose(3)}"), (5, "too short Item"), (6, f"{prose(4)} pay 7 dollars to Ann now {prose(4)}"),
            (7, "pay 8 dollars to Ann now"), (None, "five small words stand here"), (1, "again five small words stand here")]
    bench = items(spark, [(1, "Five small words stand here."), (2, "too short item"), (3, "Pay 7 dollars to Ann now"), (4, ITEM)])
    found = {(r.doc_id, r.item_id) for r in templates.find_leaks(documents(spark, rows), bench).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (4, 4), (6, 3)}


def test_items_with_few_ordinary_words(spark, prose):
    dense = "What is 12 + 7 + 9 + 30 + 4 + 8 + 15 + 2?"
    stretch = f"{prose(6)} 1 2 3 4 5 6 7 8 9 {prose(6)}"
    thin = "Add 1 2 3 4 5 6 and 7 8 then 9 10 11 12 13"
    docs = documents(spark, [(i, f"{prose(i)}. {dense} {prose(4)}") for i in range(1, 9)]
                     + [(100 + i, f"{prose(i)} {stretch} {prose(4)}") for i in range(1, 9)]
                     + [(200 + i, f"{prose(i)}. {thin} {prose(4)}") for i in range(1, 9)] + [(300, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16")])
    found = {(r.doc_id, r.item_id) for r in templates.find_leaks(docs, items(spark, [(1, dense), (2, stretch), (3, thin)])).collect()}
    assert found == {(100 * k + i, k + 1) for k in range(3) for i in range(1, 9)}


def test_names_anywhere_and_other_layout(spark, prose):
    tom = "Tom has 3 apples. Tom buys 5 more red apples. Tom then eats 2 of them. How many apples does Tom have?"
    road = "they went by train from Rome to London and from there on to Bristol again"
    docs = documents(spark, [
        (1, f"{prose(9)}. {tom.replace('Tom', 'Anna').replace('3', '8').replace('5', '14').replace('2', '6')} {prose(5)}"),
        (2, f"{prose(9)} {road.replace('to London', chr(10).join(('to', 'London')))} {prose(5)}"),
        (3, f"{prose(9)} “{road.replace('from Rome', 'from  Rome')}” {prose(5)}"), (4, tom.replace("does Tom", "does Anna"))])
    leaks = templates.find_leaks(docs, items(spark, [(1, tom), (2, road)])).collect()
    assert {(r.doc_id, r.item_id) for r in leaks if r.doc_id < 4} == {(1, 1), (2, 2), (3, 2)}


def test_every_offset_is_reached(spark, prose):
    item = prose(15)
    docs = documents(spark, [(i, f"{prose(i)} {item} {prose(3)}") for i in range(1, 25)])
    assert templates.find_leaks(docs, items(spark, [(1, item)])).count() == 24


def test_clean_rows_stay(spark, awkward, prose):
    docs = documents(spark, awkward + [(900, ITEM)]).selectExpr("*", "1 AS _row", "2 AS item", "3 AS print")
    leaks = templates.find_leaks(docs, items(spark, [(1, ITEM)]))
    left = templates.without_leaks(docs, leaks)
    assert left.columns == docs.columns and left.count() == len(awkward) and left.where("doc_id = 900").count() == 0


def test_empty_tables(spark, awkward):
    docs, bench = documents(spark, awkward), items(spark, [(1, ITEM)])
    assert templates.find_leaks(docs.where("false"), bench).collect() == []
    assert templates.find_leaks(docs, bench.where("false")).collect() == []
    assert templates.find_leaks(docs, items(spark, [(1, None)])).collect() == []
