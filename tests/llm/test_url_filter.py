import random

import duckdb
import pytest

from basketlens.llm import queries
from basketlens.llm import url_filter as uf

from .util import SF, docs_frame


def brute(url, rules, default="allow"):
    host, path = uf.split_url(url)
    fits = [(len(h) + len(p), v == "allow", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.mark.parametrize("url,want", [
    (None, ("", "")), ("", ("", "")), ("no scheme", ("", "")), ("http://", ("", "")), ("HTTP://Example.COM", ("example.com", "")),
    ("https://a.b/c?d#e", ("a.b", "/c")), ("https://a.b?d/e", ("a.b", "")), ("x://a#/b", ("a", "")), ("http://É.com:80/Ü", ("É.com:80", "/Ü")),
    ("http://a/http://b/", ("a", "/http://b/"))])
def test_split(url, want):
    assert uf.split_url(url) == want


def test_trie_equals_brute_force():
    rng = random.Random(1)
    hosts = [".".join(rng.choice(["com", "net", "a", "b", "www", "example"]) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    paths = ["".join("/" + rng.choice(["", "en", "es", "e", "x"]) for _ in range(rng.randrange(0, 4))) for _ in range(60)]
    for _ in range(60):
        rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(rng.randrange(0, 30))]
        trie = uf.RuleTrie(rules)
        for _ in range(100):
            url = f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/', 'n', '?q', '#/en/'])}"
            best = trie.match(*uf.split_url(url))
            host, path, rule, verdict = brute(url, rules)
            got = (best[1] if best else "allow", best and best[0])
            assert got == (verdict, rule and len(rule)), (url, rules)


def test_query_rules():
    judge = {u: brute(u, queries.URL_RULES)[2:] for u in ("http://x.com/", "http://x.com", "http://example.com/en/1", "http://a.example.com/en/1", "http://www.example.com/en/1",
                                                          "http://m.www.example.com/en/", "http://example.com/english/", "http://x.net/es/", "http://x.net/es", "http://net/fr/1", "http://x.org/")}
    trie = uf.RuleTrie(queries.URL_RULES)
    for u, (rule, verdict) in judge.items():
        best = trie.match(*uf.split_url(u))
        assert (best and best[2], best[1] if best else "allow") == (rule, verdict), u


def test_frames_and_limits(spark, monkeypatch):
    df = docs_frame(spark, [(1, "http://x.com/a", "old"), (1, "http://x.com/a", "old"), (2, None, None)], "page_id long, url string, host string")
    out = sorted(tuple(r) for r in uf.judge(df, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    assert out == [(1, "x.com", "/a", "com/", "allow"), (1, "x.com", "/a", "com/", "allow"), (2, "", "", None, "allow")]
    assert uf.judge(docs_frame(spark, [], "page_id long, url string"), ()).count() == 0
    assert {r.verdict for r in uf.judge(df, (), default="block").collect()} == {"block"}
    monkeypatch.setattr(uf, "MAX_RULES", 2)
    with pytest.raises(ValueError, match="rules"):
        uf.RuleTrie(queries.URL_RULES)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP7_SQL}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in queries.QUERIES["op7_url_filter"](spark, SF).orderBy("page_id").collect()] == want
