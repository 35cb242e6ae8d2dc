"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (chains, htmlblocks, infill, pairbpe, pathjoin, prefixtrie, projections, shardtable, suffixes, templates, topk,
               warc, windows)

SHARDS = [f"shard-{i:02d}" for i in range(16)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = htmlblocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on four-word shingles."""
    return pathjoin.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS s
  FROM w
), items AS (
  SELECT r, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.r AS ra, b.r AS rb, count(*) AS n FROM items a JOIN items b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2
), links AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM shared JOIN sets x ON x.r = ra JOIN sets y ON y.r = rb
  WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), reach(a, b) AS (
  SELECT DISTINCT doc_id, doc_id FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, coalesce(doc_id = c, true) AS kept
FROM sets LEFT JOIN least ON a = doc_id
"""


#: Order of the chain. A text of low quality tells about toxicity, so it comes first.
CATEGORIES = ("low_quality", "toxic")


def toxicity_chain(spark: SparkSession, sf_dir: str, docs: DataFrame) -> chains.Chain:
    """A chain fitted on the labelled rows among ``docs``."""
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")
    return chains.fit(chains.sample(labels, docs), CATEGORIES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the categories, and the verdict on toxicity, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = chains.score(docs, toxicity_chain(spark, sf_dir, docs))
    return scored.select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, by its id."""
    return shardtable.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


OP4_SQL = f"""
WITH RECURSIVE shard AS (
  SELECT i, printf('shard-%02d', i) AS name FROM range({len(SHARDS)}) t(i)
), prefs AS (
  SELECT list(CAST('0x' || substr(sha256('offset:' || name), 1, 15) AS BIGINT) % {shardtable.SLOTS} ORDER BY i) AS pos,
    list(CAST('0x' || substr(sha256('skip:' || name), 1, 15) AS BIGINT) % {shardtable.SLOTS - 1} + 1 ORDER BY i) AS step
  FROM shard
), fill(turn, pos, step, owner) AS (
  SELECT 0, pos, step, list_transform(range({shardtable.SLOTS}), lambda x: -1) FROM prefs
  UNION ALL
  SELECT CASE WHEN owner[pos[turn % {len(SHARDS)} + 1] + 1] < 0 THEN turn + 1 ELSE turn END,
    list_transform(pos, lambda a, k: CASE WHEN k = turn % {len(SHARDS)} + 1 AND owner[a + 1] >= 0
      THEN (a + step[k]) % {shardtable.SLOTS} ELSE a END),
    step,
    CASE WHEN owner[pos[turn % {len(SHARDS)} + 1] + 1] < 0
      THEN list_concat(owner[1:pos[turn % {len(SHARDS)} + 1]], [turn % {len(SHARDS)}], owner[pos[turn % {len(SHARDS)} + 1] + 2:])
      ELSE owner END
  FROM fill WHERE turn < {shardtable.SLOTS}
), lookup AS (
  SELECT owner FROM fill WHERE turn = {shardtable.SLOTS}
), slotted AS (
  SELECT doc_id, CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
    % {shardtable.SLOTS} AS slot
  FROM documents
)
SELECT doc_id, slot, printf('shard-%02d', owner[slot + 1]) AS shard FROM slotted, lookup
"""


def vocabulary_path() -> str:
    """The tokenizer file: what BPE_VOCABULARY names, or that of the installed public tokenizers."""
    named = os.environ.get("BPE_VOCABULARY")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    coded = pairbpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leaked into documents."""
    leaks = templates.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id", "item_id").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("exact").alias("exact"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth vector, against all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM scored QUALIFY rank <= 10
"""

def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ledger = warc.write_archives(pages, scratch_path(spark, "warc"))
    records = warc.record_table(warc.read_chunks(ledger))
    checked = F.when(~F.col("intact"), F.raise_error(F.lit("a record was damaged"))).otherwise(F.col("payload_digest"))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", checked.cast("string").alias("payload_digest"),
                          "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, body, array_to_string(list_transform(range(32),
      lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
        (CAST('0x' || substr(hex || '00', CAST(1 + (5 * i) // 8 * 2 AS BIGINT), 4) AS BIGINT)
         >> CAST(11 - (5 * i) % 8 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest
  FROM p
), f AS (
  SELECT body, min(page_id) AS first FROM d GROUP BY body
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (body)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows that an earlier document has."""
    cut = windows.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t-\r]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that an earlier document has."""
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit("").cast("binary"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2(kept, 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT r, doc_id, i, hash(words[i:i + 12]) AS g, words[i:i + 12] AS v
  FROM w, unnest(range(1, len(words) - 11)) t(i)
), firsts AS (
  SELECT g, v, min(doc_id) AS d FROM win GROUP BY g, v HAVING min(doc_id) < max(doc_id)
), bad AS (
  SELECT DISTINCT r, i + k AS p FROM win JOIN firsts USING (g, v), range(13) t(k) WHERE d < doc_id
), gone AS (
  SELECT r, count(*) AS n, list(p) AS ps FROM bad GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words
    ELSE list_filter(words, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the conversations, each rebuilt on the head of its family's first."""
    turns = prefixtrie.turn_table(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(turns))


OP11_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, xor(list_reduce(list_transform(range(length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295
      ELSE ascii(substr(CAST(conv_id AS VARCHAR), i, 1))::BIGINT END),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
    4294967295) % 9 AS h FROM t
), r AS (
  SELECT h.conv_id, coalesce(b.own, [])[1:h.h] || h.own[h.h + 1:] AS turns
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5
), m AS (
  SELECT conv_id, d AS depth, turns[1:d] AS p, len(turns) = d AS ends FROM r, unnest(range(len(turns) + 1)) u(d)
), n AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(array_to_string(list(conv_id ORDER BY conv_id) FILTER (ends), ','), '') AS ids FROM m GROUP BY p, depth
), c AS (
  SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (p, depth)
), up AS (
  SELECT p[1:k] AS p, k AS depth, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * CASE WHEN depth > 0 THEN strlen(p[depth].t) ELSE 0 END) AS saved FROM v, unnest(range(depth + 1)) u(k) GROUP BY ALL
)
SELECT v.conv_id, v.depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, up.n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ids) AS ends_sha256
FROM v JOIN up USING (p, depth) LEFT JOIN n a ON a.p = v.p[1:v.depth - 1] AND a.depth = v.depth - 1
"""


def op12_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors found for every hundredth vector, against all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return projections.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and digests of every document rearranged for infilling, and restored."""
    moved = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return infill.restore(moved).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
        OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p
), m AS (
  SELECT *, strpos(output, '<P>') AS ip, strpos(output, '<S>') AS is_, strpos(output, '<M>') AS im FROM o
)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, ip + 3, is_ - ip - 3) || substr(output, im + 3) || substr(output, is_ + 3, im - is_ - 3)
    ELSE substr(output, ip + 3, im - ip - 3) || substr(output, im + 3) || substr(output, is_ + 3, ip - is_ - 3)
    END) AS restored_sha256
FROM m
"""

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_top_k": op7_top_k,
    "op8_warc": op8_warc,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ann": op12_ann,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {
    "op2_near_dedup": OP2_SQL,
    "op4_sharding": OP4_SQL,
    "op7_top_k": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
