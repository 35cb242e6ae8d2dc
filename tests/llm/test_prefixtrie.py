"""The trie of conversations against one built turn by turn."""

import hashlib
import random
import zlib

import pytest
from trackscore.llm import prefixtrie
from trackscore.llm.prefixtrie import prefix_trie, rebuilt, turn_table

SCHEMA = "conv_id long, turn long, role string, text string, conv int, pos string, seg int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA).repartition(parts)


def brute(rows, rebuild=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            name = f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()
            own.setdefault(c, []).append(((t is not None, t or 0, hashlib.sha256(name).digest()), (r or "", x or "")))
    own = {c: [turn for _, turn in sorted(turns, key=lambda z: z[0])] for c, turns in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - abs(c) % 5 * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + turns[h:] if rebuild else turns
    members, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    below, out = {}, []
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        below[p] = (sum(below[k][0] for k in kids) or 1, sum(below[k][1] for k in kids)
                    + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0))
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), *below[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def talk(seed, n, words, long=0, copies=0):
    """Short conversations over few texts, long ones that share beginnings, copies, and awkward rows."""
    rng = random.Random(seed)
    rows = [(c - 7, t if rng.random() < 0.95 else None, rng.choice(["u", "a", None]) if rng.random() < 0.1 else "u",
             rng.choice(["x", "yé", None, ""][:words])) for c in range(n) for t in range(rng.randint(1, 9))]
    base = [rng.choice("xy") for _ in range(40)]
    rows += [(c, t, "u", base[t] if rng.random() < 0.97 else "z") for c in range(1000, 1000 + long) for t in range(rng.randint(5, 40))]
    rows += [(c, t, "u", f"t{t}") for c in range(2000, 2000 + copies) for t in range(12)]
    rows += [(None, 0, "u", "x"), (None, None, None, None), (-3, 1, "u", "x"), (-3, 1, "u", "x")]
    rng.shuffle(rows)
    return rows


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed, n, words, long, segment", [(1, 150, 4, 20, 64), (2, 80, 2, 30, 4), (3, 0, 2, 20, 1)])
def test_agrees_with_a_plain_trie(spark, seed, n, words, long, segment):
    rows = talk(seed, n, words, long, copies=30)
    trie = prefix_trie(rebuilt(turn_table(table(spark, rows))), segment=segment)
    assert trie.columns == list(prefixtrie.NODES)
    assert got(trie) == brute(rows)


def test_conversations_as_they_are_and_hot_ones_in_ranges(spark):
    rows = talk(4, 40, 3, 10)
    rows += [(5000, t, "u", "again") for t in range(300)]  # one conversation holds a third of the turns
    turns = turn_table(table(spark, rows), hot_rows=50, chunk_rows=32)
    assert got(prefix_trie(turns, segment=8)) == brute(rows, rebuild=False)


def test_copies_over_many_partitions(spark):
    """All partitions hold rows of one node; its ids come in pieces."""
    rows = [(c, t, "u", f"t{t}") for c in range(300) for t in range(3)]
    before, pieces = spark.conf.get("spark.sql.shuffle.partitions"), prefixtrie.PIECE_IDS
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        prefixtrie.PIECE_IDS = 7
        assert got(prefix_trie(turn_table(table(spark, rows)))) == brute(rows, rebuild=False)
        assert got(prefix_trie(rebuilt(turn_table(table(spark, rows))))) == brute(rows)
    finally:
        prefixtrie.PIECE_IDS = pieces
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_turnless_conversations_very_long_texts_and_empty_tables(spark):
    # With h beyond its own turns and no base, a conversation has no turns but stays a member of the root.
    alone = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:6]
    rows = [(c, 0, "u", "only") for c in alone]
    assert got(prefix_trie(rebuilt(turn_table(table(spark, rows))))) == brute(rows)
    rows = [(i, t, "u", "long " * 200_000 if t == 1 else "x") for i in range(3) for t in range(3)]
    assert got(prefix_trie(turn_table(table(spark, rows)))) == brute(rows, rebuild=False)
    empty = table(spark, rows).where("false")
    assert got(prefix_trie(rebuilt(turn_table(empty)))) == []
