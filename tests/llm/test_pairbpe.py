"""BPE against the tokenizers library."""

import random

import pytest
from llm_help import documents

from trackscore.llm import pairbpe
from trackscore.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "Hello world's don't 12345 <|endoftext|>foo <|startoftext|> a", "ΟΔΥΣΣΕΥΣ İstanbul é é a b\x1cc\x85d", "日本語 🎉🎉",
    "aaaaaaaaa bbbb ababab !!!!!", "", " \n ", "<|ENDOFTEXT|> 'RE I'LL x'ſ", "Ḉa﻿ ₝ ẞ ß", " ", "x" * 4000,
]


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(vocabulary_path())
    found.no_truncation()
    found.no_padding()
    return found


def test_agrees_with_the_library(spark, awkward, library):
    rng = random.Random(2)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x600), 32, rng.randrange(0x3000, 0x3100)]))
                     for _ in range(rng.randrange(50))) for _ in range(300)]
    rows = awkward + [(1000 + i, t) for i, t in enumerate(TEXTS + noise)]
    got = pairbpe.encode(documents(spark, rows), vocabulary_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == " ".join(map(str, ids)), r.text
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.lang == "en" and r._id == -1


def test_small_steps_and_a_full_memo_change_nothing(monkeypatch, library):
    import pyarrow as pa

    coder = pairbpe.Coder(pairbpe.Vocabulary.read(vocabulary_path()).tables())
    texts = pa.array(TEXTS * 3)
    want = coder.encode(texts)
    monkeypatch.setattr(pairbpe, "MEMO", 3)
    assert coder.encode(texts.slice(0, 7))[0] == want[0][:7]
    assert coder.encode(texts) == want
    batch = pa.record_batch([texts], names=["_text"])
    monkeypatch.setattr(pairbpe, "STEP_BYTES", 50)
    steps = list(pairbpe._steps([batch.slice(0, 4), batch.slice(4)]))
    assert sum((s.column("_text").to_pylist() for s in steps), []) == texts.to_pylist() and len(steps) > 5


def test_empty_table_and_other_files(spark, awkward, tmp_path):
    assert pairbpe.encode(documents(spark, awkward).where("false"), vocabulary_path()).collect() == []
    other = vocabulary_path().replace("word_bpe_49k", "byte_bpe_50k")
    with pytest.raises((ValueError, KeyError, TypeError)):
        pairbpe.Vocabulary.read(other)


def test_tables_need_no_package_to_be_loaded():
    """Executors get the tables by a broadcast, which pickles classes by name: there are only built-in types and arrays."""
    import pickle
    import pickletools

    data = pickle.dumps(pairbpe.Vocabulary.read(vocabulary_path()).tables())
    names = {arg for op, arg, _ in pickletools.genops(data) if op.name in ("GLOBAL", "SHORT_BINUNICODE") and isinstance(arg, str)}
    assert not any(n.startswith("trackscore") for n in names)
