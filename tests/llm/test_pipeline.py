"""The corpus pipeline over a small corpus with planted rows."""

import pytest
from llm_help import words_of

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage, leak, base = prose(60), prose(40), prose(200)
    near = base.split()
    near[50] = "changed"
    rows = [(i, prose(60)) for i in range(200)]
    rows += [(i, f"{prose(20)} {'zogfoo '}{prose(20)} {'zogbar'} {prose(5)}") for i in range(200, 260)]  # toxic
    rows += [(300, base), (301, base), (302, " ".join(near)), (303, f"{prose(80)} {passage} {prose(80)}"),
             (304, f"{prose(90)} {passage} {prose(70)}"), (305, f"{prose(50)} {leak} {prose(50)}"), (306, ""), (307, None), (None, prose(30)),
             (308, prose(5000))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 7 > 0), int(200 <= i < 260)) for i in range(260) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, prose(30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict((i, t) for i, t in rows), passage


def test_stages_catch_what_is_planted_and_keep_the_rest(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept, seen = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "bpe":
            assert docs.columns == columns
        rows = docs.collect()
        seen[name] = {r.doc_id: r for r in rows}
        kept[name] = set(seen[name])
        docs = spark.createDataFrame(rows, docs.schema)
    toxic = set(range(200, 260))
    assert kept["toxicity"] == set(texts) - toxic
    assert kept["near_dedup"] == kept["toxicity"] - {301, 302}
    assert kept["substring_dedup"] == kept["near_dedup"]
    assert kept["decontamination"] == kept["near_dedup"] - {305} == kept["bpe"]
    cut = seen["substring_dedup"]
    assert passage in cut[303].text and words_of(cut[304].text) == words_of(texts[304].replace(passage, ""))
    assert cut[304].n_chars == len(cut[304].text)
    assert all(r.text == texts[i] for i, r in cut.items() if i != 304)
    assert all((r.n_tokens == 0) == (not (r.text or "").strip()) for r in seen["bpe"].values())


def test_run_gives_the_last_stage_and_handles_empty_tables(spark, corpus, tmp_path):
    folder, texts, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == len(texts) - 60 - 2 - 1
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
