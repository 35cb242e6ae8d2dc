"""Documents with awkward rows, shared by the tests of this folder."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

@pytest.fixture(scope="session")
def prose():
    """A maker of seeded prose."""
    rng = random.Random(11)
    stems = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]

    def make(n):
        return " ".join(rng.choice(stems) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def awkward(prose):
    """(doc_id, text) rows: copies, near copies, a shared passage, short, empty, blank, null and long texts."""
    passage, base = prose(60), prose(120)
    rows = [(i, prose(40 + i % 30)) for i in range(1, 30)]
    rows += [(100 + i, f"{prose(20)} {passage}\n{prose(15)}") for i in range(12)]
    for i in range(40):  # a group of near copies of one text
        words = base.split()
        for _ in range(i % 5):
            words[(i * 7) % 100] = prose(1)
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, base.upper() if i % 2 else base) for i in range(10)]
    rows += [(400, ""), (401, None), (402, " \n\t "), (403, "one two"), (404, "One two"), (405, "one  two three"),
             (406, "café " * 30), (407, "a b c d " * 2000 + passage), (408, passage), (409, "x" * 5000)]
    rows += [(None, passage), (None, None), (200, base), (5, rows[4][1]), (5, prose(30))]
    return rows
