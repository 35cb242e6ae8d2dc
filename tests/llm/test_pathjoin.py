"""Near-duplicate groups against brute force over all pairs."""

from llm_help import documents, words_of

from trackscore.llm import components, pathjoin


def shingles(text, width):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def found(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect()), key=repr)


def test_agrees_with_brute_force(spark, awkward):
    docs = documents(spark, awkward)
    assert found(pathjoin.near_duplicates(docs, width=4)) == brute(awkward, 4)


def test_large_groups_of_near_copies(spark, prose):
    """More members than a leaf holds, around one text and along a chain of edits."""
    base, rows = prose(100).split(), []
    for i in range(150):
        words = list(base)
        for k in range(i % 9):
            words[(i * 13 + k * 11) % 100] = prose(1)
        rows.append((i, " ".join(words)))
    chain = prose(100).split()
    for i in range(60):
        chain[(i * 3) % 100] = f"w{i}"
        rows.append((1000 + i, " ".join(chain)))
    docs = documents(spark, rows)
    got = found(pathjoin.near_duplicates(docs, width=5, leaf=8, depth=4))
    assert got == brute(rows, 5)


def test_lone_bridges_between_large_groups(spark, prose):
    """Pairs of groups of near copies; one pair of members, neither central, is the only link, at 0.81."""
    rows = []
    for g in range(8):
        base = [f"g{g}x{i}" for i in range(200)]
        other = [f"{w}new" if i in (20, 50, 80, 110, 140, 170) else w for i, w in enumerate(base)]
        for side, words in enumerate((base, other)):
            for i in range(150):
                own = list(words)
                own[(i * 7 + 3) % 200] = f"own{side}n{i}"
                rows.append((g * 1000 + side * 300 + i, " ".join(own)))
        near = [f"{w}new" if i == 20 else w for i, w in enumerate(base)]
        far = [w if i == 170 else other[i] for i, w in enumerate(base)]
        rows += [(g * 1000 + 700, " ".join(near)), (g * 1000 + 701, " ".join(far))]
    assert 100 * len(shingles(rows[300][1], 5) & shingles(rows[301][1], 5)) >= 80 * len(shingles(rows[300][1], 5) | shingles(rows[301][1], 5))
    got = found(pathjoin.near_duplicates(documents(spark, rows), width=5, leaf=8, depth=2))
    assert {component for _, _, component, _ in got} == {g * 1000 for g in range(8)}


def test_empty_table(spark, awkward):
    assert pathjoin.near_duplicates(documents(spark, awkward).where("false")).collect() == []


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 200)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}, 200: 200, 300: 200}
