"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from strandframe.llm.chat_format import format_chats, parse_chats
from strandframe.llm.decontamination import contamination
from strandframe.llm.fingerprints import edit_check
from strandframe.llm.hyperminhash import near_duplicates_of
from strandframe.llm.jaccard_join import jaccard_components
from strandframe.llm.language_id import identify, train
from strandframe.llm.packing import pack_sequences
from strandframe.llm.quality import fit, scored, with_features
from strandframe.llm.sharding import ShardStore
from strandframe.llm.spelling import counted_words, spelling_variants
from strandframe.llm.token_counts import count_tokens
from strandframe.llm.url_filter import filter_urls
from strandframe.llm.whitening import whiten
from strandframe.runtime import read_table, shared_dir, written

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: A text with an escape, a header and an end that common templates use.
HOSTILE = "\\### Assistant: </turn> ok"

ARRIVALS, BASE_BYTES, FANOUT, TARGET_BYTES = 22, 1 << 20, 4, 64 << 20


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in 22 shards, are compacted, and are read back by the manifest."""
    store = ShardStore(spark, shared_dir(spark, "shards"), BASE_BYTES, FANOUT, TARGET_BYTES)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    store.append(docs.withColumn("batch", F.pmod(F.floor(F.coalesce("doc_id", F.lit(0)) / 7), F.lit(ARRIVALS))), "batch")
    store.compact()
    store.vacuum(grace_seconds=0)  # nobody else writes here
    rows = store.read()
    if rows is None:
        return docs.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("first_arrival", "last_arrival", "tier", "run_rows", "run_bytes", "n_bytes")))
    return rows.select(
        "doc_id",
        "first_arrival",
        "last_arrival",
        F.col("tier").cast("long").alias("tier"),
        F.col("n_rows").alias("run_rows"),
        F.col("n_bytes").alias("run_bytes"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )


def _remainder(n: int):
    """crc32 of the id as text, modulo n; a null id is in no held-out part."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = train(docs.where((_remainder(5) != 0) & F.col("doc_id").isNotNull()))
    found = identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    back = parse_chats(format_chats(turns.unionByName(planted)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_features(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    rows = written(rows, "quality")
    model = fit(rows.where(_remainder(3) != 1), read_table(spark, sf_dir, "labels"))
    return scored(rows, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_check(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(counted_words(read_table(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op13_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates_of(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_sharding": op5_sharding,
        "op6_language_id": op6_language_id,
        "op7_chat_format": op7_chat_format,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_packing": op9_packing,
        "op10_fingerprints": op10_fingerprints,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_hyperminhash_near_dedup": op13_hyperminhash_near_dedup,
    }


_OP1 = """
WITH u AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END, '') AS path
  FROM u
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
         ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), m AS (
  SELECT page_id, host, path, rule, verdict, length(rule) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), b AS (SELECT page_id, arg_max(rule, n) AS rule, arg_max(verdict, n) AS verdict FROM m GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (page_id)
"""


_OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw USING (n, g)
), words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN c cx ON cx.doc_id = x.doc_id JOIN c cy ON cy.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (min(cx.n) + min(cy.n) - count(*))
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def _op5() -> str:
    """The same merges in SQL: one level after the other, as far as sizes of 2**62 bytes."""
    tier = f"(CASE WHEN b < {BASE_BYTES} THEN 0 ELSE CAST(floor(ln(b / {BASE_BYTES}.0) / ln({FANOUT}) + 1e-9) AS INTEGER) + 1 END)"
    parts = [
        f"""d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
              CAST(((coalesce(doc_id, 0) // 7) % {ARRIVALS} + {ARRIVALS}) % {ARRIVALS} AS BIGINT) AS arrival FROM documents)""",
        f"s AS (SELECT arrival AS fa, arrival AS la, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_bytes) AS BIGINT) AS b FROM d GROUP BY arrival)",
        f"l0 AS (SELECT fa, la, n, b, {tier} AS t FROM s)",
    ]
    for k in range(12):
        parts += [
            f"w{k} AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY fa) - 1 AS i, count(*) OVER (PARTITION BY t) AS c FROM l{k})",
            f"m{k} AS (SELECT min(fa) AS fa, max(la) AS la, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS b FROM w{k} WHERE t = {k} AND i < c - c % {FANOUT} GROUP BY i // {FANOUT})",
            f"l{k + 1} AS (SELECT fa, la, n, b, t FROM w{k} WHERE NOT (t = {k} AND i < c - c % {FANOUT}) UNION ALL SELECT fa, la, n, b, greatest({tier}, {k + 1}) FROM m{k})",
        ]
    return f"""WITH {", ".join(parts)}
SELECT d.doc_id, r.fa AS first_arrival, r.la AS last_arrival, CAST(r.t AS BIGINT) AS tier, r.n AS run_rows, r.b AS run_bytes, CAST(d.n_bytes AS BIGINT) AS n_bytes
FROM d JOIN l12 r ON d.arrival BETWEEN r.fa AND r.la"""


_OP7 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, regexp_replace(replace(text, '\\', '\\\\'), '<(/?turn)', '<\\\\\\1', 'g') AS enc,
    replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E') AS erole,
    lag(role) OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(enc) + CASE WHEN before = role THEN 7 ELSE length(erole) + 7 + 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


# crc32 byte by byte, over a table of 256 remainders that the query makes itself.
_OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))
), runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
  ) WHERE length(run) >= 6 GROUP BY doc_id, run
), hexed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, c, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(0, CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS BIGINT))),
      lambda h, b: xor(h // 256, t[CAST(xor(h % 256, b) + 1 AS BIGINT)])), 4294967295) AS h
  FROM hexed, crc
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, y.word AS near, y.n AS m FROM cut x JOIN cut y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.d = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.d = y.word
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 5 * w.n THEN r.near END AS form, CASE WHEN r.m >= 5 * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1
), chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL
), roots AS (SELECT chain.word, chain.at AS root FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r USING (word)
"""


_OP13 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), z AS (SELECT doc_id, g, n FROM s JOIN c USING (doc_id)
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM z x JOIN z y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (min(x.n) + min(y.n) - count(*))
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a), k AS (
  SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _OP1,
        "op2_decontamination": _OP2,
        "op4_ngram_jaccard_join": _OP4,
        "op5_sharding": _op5(),
        "op7_chat_format": _OP7,
        "op11_spelling_variants": _OP11,
        "op13_hyperminhash_near_dedup": _OP13,
    }
