import hashlib
import os

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strandframe.llm import queries as Q
from strandframe.llm.decontamination import split_words
from strandframe.llm.sharding import CommitConflict, ShardStore
from strandframe.runtime import shared_dir

SF = "/root/testdata/sf0.001"


def docs(spark, n, a=0):
    return spark.range(a, a + n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))


def test_appends_merges_and_reads_keep_every_row(spark):
    store = ShardStore(spark, shared_dir(spark, "shards"), base_bytes=500, fanout=3, target_bytes=4000)
    assert store.version() == 0 and store.read() is None
    for k in range(7):
        store.append(docs(spark, 40, 40 * k))
    store.append(docs(spark, 300, 280).withColumn("b", F.col("doc_id") % 4), "b")
    v = store.version()
    before = store.read(v)
    assert before.count() == 580
    last = store.compact()
    assert last == v + 1 and store.compact() == last
    tiers = [r.tier for r in store.runs()]
    assert all(tiers.count(t) < 3 for t in tiers)
    assert sum(r.n_rows for r in store.runs()) == 580
    now = sorted((r.doc_id, r.text) for r in store.read().select("doc_id", "text").collect())
    assert now == sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
    assert store.read(1).count() == 40
    assert store.vacuum() == 0 and store.vacuum(grace_seconds=0) > 0 and store.read().count() == 580


def test_two_writers_of_one_version_conflict(spark):
    root = shared_dir(spark, "shards")
    a, b = ShardStore(spark, root, 100, 2), ShardStore(spark, root, 100, 2)
    a.append(docs(spark, 5))
    seen = b.version()
    a.append(docs(spark, 5, 5))
    with pytest.raises(CommitConflict):
        b.commit(b.runs(seen), seen)
    assert a.version() == 2 and a.read().count() == 10


@pytest.mark.parametrize("dies_at", ["before the claim", "after the claim", "after the staged file"])
def test_a_writer_that_dies_blocks_nobody(spark, monkeypatch, dies_at):
    root = shared_dir(spark, "shards")
    store = ShardStore(spark, root, 100, 2, lease_seconds=0)
    store.append(docs(spark, 5))

    class Killed(BaseException):
        pass

    def die(*_):
        raise Killed

    with monkeypatch.context() as m:
        if dies_at == "before the claim":
            m.setattr(ShardStore, "_claim", die)
        elif dies_at == "after the claim":
            m.setattr(ShardStore, "_put", lambda self, path, text, replace, f=ShardStore._put: f(self, path, text, replace) if "claim" in path.getName() else die())
        else:
            m.setattr(ShardStore, "_said", die)
        with pytest.raises(Killed):
            store.append(docs(spark, 7, 5))
    assert store.version() == 1 and store.read().count() == 5
    if dies_at != "before the claim":  # while the lease lasts nobody else may commit
        with pytest.raises(CommitConflict):
            ShardStore(spark, root, 100, 2).append(docs(spark, 7, 5))
    assert store.append(docs(spark, 7, 5)) == 2 and store.read().count() == 12


def test_a_writer_whose_claim_was_taken_over_changes_nothing(spark, monkeypatch):
    root = shared_dir(spark, "shards")
    slow, fast = ShardStore(spark, root, 100, 2), ShardStore(spark, root, 100, 2, lease_seconds=0)
    put = ShardStore._put

    def late(self, path, text, replace):
        put(self, path, text, replace)
        if self is slow and "claim" in path.getName():
            fast.append(docs(spark, 3))

    monkeypatch.setattr(ShardStore, "_put", late)
    with pytest.raises(CommitConflict):
        slow.append(docs(spark, 9))
    assert fast.version() == 1 and fast.read().count() == 3


def test_vacuum_spares_what_is_about_to_be_committed(spark, monkeypatch):
    root = shared_dir(spark, "shards")
    store, other = ShardStore(spark, root, 100, 2), ShardStore(spark, root, 100, 2)
    store.append(docs(spark, 5))
    commit = ShardStore.commit
    monkeypatch.setattr(ShardStore, "commit", lambda self, runs, seen: (other.vacuum(), commit(self, runs, seen))[1])
    store.append(docs(spark, 7, 5))
    assert store.read().count() == 12


def test_payload_columns_named_like_the_store_s(spark):
    store = ShardStore(spark, shared_dir(spark, "shards"), 10, 2)
    df = spark.createDataFrame([(1, "a", 5, "r", 9, "m"), (2, "b", 6, "s", 8, None)], "doc_id long, text string, tier int, run_id string, arrival int, _folder string")
    store.append(df)
    store.append(df)
    store.compact()
    got = store.read()
    assert {"tier", "_tier", "run_id", "_run_id"} <= set(got.columns)
    assert sorted(tuple(r) for r in got.select(df.columns).collect()) == sorted(tuple(r) for r in df.union(df).collect())
    with pytest.raises(ValueError):
        store.append(df.withColumnRenamed("tier", "_shard_arrival"))


def test_the_manifest_is_broadcast(spark):
    store = ShardStore(spark, shared_dir(spark, "shards"), 100, 2)
    store.append(docs(spark, 50))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_null_payloads_extra_columns_and_empty_arrivals(spark):
    store = ShardStore(spark, shared_dir(spark, "shards"), 10, 2)
    df = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (None, "é", None)], "doc_id long, text string, tier_name string")
    store.append(df)
    store.append(df.limit(0))
    store.compact()
    got = store.read()
    assert got.count() == 3 and {"tier_name", "run_id", "tier"} <= set(got.columns)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.queries()[name](spark, SF)
    cur = c.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted((tuple(r[names.index(n)] for n in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in order) for r in got.collect()), key=repr) == want


def test_pipeline_stages_decide_as_brute_force_does(spark):
    """Each stage on its predecessor's rows: what goes, what stays, and nothing altered."""
    at = spark.read.parquet(f"{SF}/documents.parquet")
    columns = at.columns
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [split_words(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(g) for g in grams}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "ngram_jaccard", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, name)
        stage(spark, at, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "packing":
            break
        assert out.columns == columns
        was, now = ({r.doc_id: r for r in d.collect()} for d in (at, out))
        assert all(now[i] == was[i] for i in now)
        gone = set(was) - set(now)
        if name == "language_id":
            assert len(gone) <= 0.01 * len(was)
        elif name == "quality":
            known = [i for i in was if i in truth]
            assert sum((i in gone) != (truth[i] == 0) for i in known) <= 0.03 * len(known)
        elif name == "ngram_jaccard":
            sets = {i: brute_set(r.text) for i, r in was.items()}
            order = sorted(was)
            links = {(a, b) for x, a in enumerate(order) for b in order[x + 1 :] if sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
            root = {i: i for i in order}

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in links:
                x, y = sorted((find(a), find(b)))
                root[y] = x
            assert set(now) == {find(i) for i in order}
        else:
            dirty = {i for i, r in was.items() for w in [split_words(r.text.encode())] if any(tuple(w[p : p + n]) in grams for n in sizes for p in range(len(w) - n + 1))}
            assert gone == dirty
        at = out
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sums = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sums == {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in at.collect()}


def brute_set(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


#: The first sentences of a declaration in languages that the documents do not have.
FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. Są obdarzeni rozumem i sumieniem. ",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. ",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. ",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler. ",
]


def test_language_stage_rejects_what_it_did_not_learn_and_keeps_short_texts(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = spark.createDataFrame([(10**7 + i, t * 20, None, "x", len(t) * 20) for i, t in enumerate(FOREIGN)], big.schema)
    junk = spark.createDataFrame([(10**7 + 50 + i, t, None, "x", len(t or "")) for i, t in enumerate(["", "12 34 !!", "½ ² ³", None])], big.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, big.unionByName(foreign).unionByName(junk), SF).select("doc_id").collect()}
    own = {r.doc_id: len(r.text) for r in big.where("text is not null and lang is not null").select("doc_id", "text").collect()}
    assert sum(10**7 + i in kept for i in range(len(FOREIGN))) <= 1
    assert not any(10**7 + 50 + i in kept for i in range(4))
    assert sum(i not in kept for i in own) <= 0.005 * len(own)
    short = [i for i, n in own.items() if 0 < n < 150]
    assert len(short) > 10 and sum(i in kept for i in short) >= 0.95 * len(short)


def test_language_rule_has_no_step(spark):
    rows = spark.createDataFrame([("x" * n,) for n in range(1, 3000)], "text string").select(F.length("text").alias("n"), corpus_pipeline.least_language("text").alias("v"))
    v = [r.v for r in rows.orderBy("n").collect()]
    assert all(0 < b - a < 0.6 / (i + 1) ** 1.5 + 1e-9 for i, (a, b) in enumerate(zip(v, v[1:], strict=False)))
    assert v[24] < 0.4 and 0.54 < v[255] < 0.56 and v[-1] < 0.6


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Null texts and ids, repeated rows and ids, columns with the stages' own names."""
    named = ["_lang_pred", "_lang_score", "_features", "_score", "_row", "_key", "_keep", "_name", "_alone", "_dc_words", "_dc_spans", "_id", "_text", "part", "n"]
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "a b c d e f g", None, None, 1), (1, None, "en", "x", 0), (1, "a b c d e f g", "en", "x", 3), (1, "a b c d e f g", "en", "x", 3), (7, "", None, None, 0)], base.schema)
    at = base.unionByName(odd)
    for i, c in enumerate(named):
        at = at.withColumn(c, F.lit(i))
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, name)
        stage(spark, at, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == at.columns
            assert all(r[c] == i for r in out.select(named).collect() for i, c in enumerate(named))
        if name == "ngram_jaccard":
            assert out.where("text = 'a b c d e f g'").count() <= 1
        if name != "quality":  # the odd rows go on
            at = out
    assert out.count() > 0


def test_operators_take_ids_of_any_type_and_clashing_columns(spark):
    from strandframe.llm.decontamination import contamination, decontaminate
    from strandframe.llm.fingerprints import edit_check, fingerprint, near_duplicates
    from strandframe.llm.jaccard_join import jaccard_components, jaccard_links, keep_one
    from strandframe.llm.packing import pack_sequences
    from strandframe.llm.token_counts import count_tokens
    from strandframe.llm.url_filter import filter_urls

    t = " ".join(f"w{i}" for i in range(30))
    rows = [("b", t, 1, 2, 3, 4), ("a", f"{t} end", 1, 2, 3, 4), (None, "null id", 1, 2, 3, 4), ("c", None, 1, 2, 3, 4), ("c", None, 1, 2, 3, 4), ("ä long id", "z " * 100, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _id int, _text int, _dc_words int, _dc_spans int")
    bench = spark.createDataFrame([("i", "w1 w2 w3"), (None, "z z z z")], "item_id string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    n = len(rows)
    assert {r.doc_id: r.component_id for r in jaccard_components(df).collect()} == {"a": "a", "b": "a", None: None, "c": "c", "ä long id": "ä long id"}
    assert keep_one(df).count() == n - 1
    assert [(r.a, r.b) for r in jaccard_links(df)[0].collect()] == [("a", "b")]
    assert [(r.a, r.b) for r in near_duplicates(df).collect()] == [("a", "b")]
    assert fingerprint(df).count() == n
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    checked = {r.doc_id: r.edited_sha256 for r in edit_check(df).collect()}
    x, y = order[1][1], order[2][1]
    assert checked["a"] == hashlib.sha256((x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode()).hexdigest()
    assert sorted(r.n_hit for r in contamination(df, bench).collect()) == [0, 0, 0, 3, 3, 100]
    clean = decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == 3
    assert count_tokens(df, path).count() == n
    assert pack_sequences(df, path).select("doc_id").distinct().count() == 5
    urls = spark.createDataFrame([("p", "http://a.org/" + "x/" * 50_000, 1), (None, None, 2)], "page_id string, url string, verdict int")
    assert sorted(r.verdict for r in filter_urls(urls, [("org/", "block")]).collect()) == ["allow", "block"]


def test_hostile_conversation_is_read_back(spark):
    r = next(x for x in Q.op7_chat_format(spark, SF).collect() if x.conv_id == -7)
    text = Q.HOSTILE
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert os.path.exists(SF)
