import hashlib
import random

from strandframe.llm.chat_format import format_chats, parse_chats
from strandframe.llm.queries import URL_RULES
from strandframe.llm.url_filter import filter_urls

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def judge(url, rules):
    """The contract, word for word, for one url."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c in UP else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for r, v in rules:
        rh, _, rp = r.partition("/")
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp):
            fits.append((rh.count("."), len(rp), v == "block", r, v))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def urls():
    rnd = random.Random(1)
    hosts = ["org", "example.org", "a.EXAMPLE.org", "notexample.org", "x.com", "com", "example.org:80", "", "b..org", "u@x.org"]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/123", "/en/2", "/fr/x", "/de/", "//de/", "/en/1/../2", "/" + "a" * 3000]
    tails = ["", "?q=/es/", "#/de/", "?x#y", "://z.com/de/"]
    made = [f"{s}{h}{p}{t}" for s in ("http://", "https://", "") for h in hosts for p in paths for t in tails]
    rnd.shuffle(made)
    return [None, "", "://", "plain"] + made[:900]


def test_urls_equal_the_contract_by_trie_and_by_join(spark):
    rows = list(enumerate(urls()))
    df = spark.createDataFrame([(i, u, "h", "clash") for i, u in rows], "page_id long, url string, host string, rule string")
    more = [*URL_RULES, ("a.example.org/es/1", "allow"), ("example.org/en/", "allow"), ("example.org/en/", "block"), ("org/en/1", "allow")]
    for rules in (URL_RULES, more):
        want = {i: judge(u, rules) for i, u in rows}
        for limit in (1 << 20, 0):
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules, broadcast_bytes=limit).collect()}
            assert got == want


def test_urls_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://x.org/"), (1, "http://x.org/"), (None, None)], "page_id long, url string")
    assert filter_urls(df, URL_RULES).count() == 3
    assert filter_urls(df.limit(0), URL_RULES).count() == 0
    assert filter_urls(df, []).where("verdict = 'allow' and rule is null").count() == 3


def test_chats_round_trip_whatever_the_texts_hold(spark):
    rnd = random.Random(2)
    bits = ["\\", "<turn", "</turn>", "</turn>\n", "<turn+>", "<turn user>", "\\### Assistant: </turn> ok", "é🙂", "\n", " ", "<\\turn", "\\\\", ">", "%3E", "x"]
    convs = {}
    for c in range(40):
        turns = []
        for t in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "assistant", "a>b<c%3E", "system"])
            turns.append((t, role, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6)))))
        convs[c] = turns
    rows = [(c, t, r, x, "z") for c, turns in convs.items() for t, r, x in turns]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = format_chats(df)
    for r in parse_chats(made).collect():
        turns = convs[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(a, x) for _, a, x in turns]
        assert r.loss_text == "".join(x for _, a, x in turns if a == "assistant")
    for r in made.collect():
        roles = [a for _, a, _ in convs[r.conv_id]]
        blocks = 1 + sum(a != b for a, b in zip(roles, roles[1:], strict=False))
        assert r.formatted.count("</turn>\n") == blocks and len(r.loss_spans) == roles.count("assistant")


def test_chats_nulls_ties_long_and_empty(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "b"), (1, 1, None, "a"), (1, 1, None, "a"), (2, 0, "assistant", "x" * 200_000), (None, 0, "user", "n")]
    rows += [(3, i, "assistant", str(i % 10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in parse_chats(format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("", "a"), ("", "a"), ("", "b")]
    assert len(got[2].loss_text) == 200_000 and got[None].turns[0].text == "n"
    assert hashlib.sha256(got[3].loss_text.encode()).hexdigest() == hashlib.sha256(("0123456789" * 200).encode()).hexdigest()
    assert format_chats(df.limit(0)).count() == 0


def test_the_longest_rule_wins_over_more_host_labels(spark):
    rules = [("org/aaaaaaaaaaaaaaaa/", "block"), ("example.org/", "allow"), ("a.org/bc", "block"), ("org/bcde", "allow"), ("ORG/x", "allow"), ("org/x", "block")]
    urls = ["http://example.org/aaaaaaaaaaaaaaaa/1", "http://example.org/b", "http://a.org/bcde", "http://b.org/bcde", "http://c.org/xyz"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    want = ["org/aaaaaaaaaaaaaaaa/", "example.org/", "a.org/bc", "org/bcde", "org/x"]
    for size in (1 << 20, 0):  # by the trie, by joins
        assert [r.rule for r in sorted(filter_urls(pages, rules, broadcast_bytes=size).collect())] == want
