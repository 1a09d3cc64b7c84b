import random

import pytest

from creditloom.llm import urlrules

RULES = [*urlrules.RULES, ("a.net", "", "allow"), ("b.a.net", "/x", "block"), ("ORG", "/fr/deep/", "block"), ("two.org", "/", "allow"), ("two.org", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("t.ie", "/x", "block"), ("ie", "/x/yz", "allow"), ("s.t.ie", "", "allow")]
ODD = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/?q", "http://www.net?x=/en/", "http://example.net/en/1", "http://xexample.net/en/1", "x://y://example.com/de/", "http://Example.COM/de/a#b/c",
    "http://a.example.com/de", "http://org/fr/", "http://x.org/fr/deep/er", "http://x.org/FR/", "http://a.net", "http://b.a.net/xyz", "http://c.b.a.net/x", "http://user@example.net:80/en/", "http://.net/", "http://net./", "http://a..net/", "http://two.org/",
    "http://" + "a." * 3000 + "net/" + "p/" * 5000, "http://é.org/fr/ü?", "http://x.org\n/fr/", "http://t.ie/x/yz", "http://s.t.ie/x/yz", "http://s.t.ie/",
]


def by_hand(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate(str.maketrans(urlrules.UPPER, urlrules.LOWER)), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h.lower() + p), len(h), v, h.lower() + p) for h, p, v in rules if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p) and host]
    best = max(fits, default=None)
    return (host, path, best and best[3], best[2] if best else otherwise)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id bigint, url string, rule string, host string").repartition(3)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
@pytest.mark.parametrize("given", [urlrules.RULES, RULES])
def test_each_url_has_its_longest_rule(spark, given, threshold):
    rng = random.Random(3)
    hosts = ["net", "example.net", "b.a.net", "org", "two.org", "example.com", "else.where"]
    urls = ODD + [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/fr/', '/de/1', '/fr/deep/2', '/x'])}{rng.choice(['', '?q=1', '#en/'])}" for _ in range(300)]
    rows = [*enumerate(urls), (None, "http://net/"), (4, urls[4]), (4, urls[4])]
    rules = spark.createDataFrame(given, "host string, path string, verdict string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = urlrules.url_verdicts(frame(spark, rows), rules).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((tuple(r) for r in found), key=repr) == sorted(((i, *by_hand(u, given)) for i, u in rows), key=repr)


def test_short_prefixes_are_confirmed_by_whole_digests(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "PREFIX_HEX", 1)
    rules = spark.createDataFrame([(f"h{i}.net", "/", "block") for i in range(200)], "host string, path string, verdict string")
    rows = [(i, f"http://h{i}.net/") for i in range(100, 300)]
    found = urlrules.url_verdicts(frame(spark, rows), rules, otherwise="unknown").collect()
    assert {(r["id"], r["verdict"]) for r in found} == {(i, "block" if i < 200 else "unknown") for i in range(100, 300)}


def test_empty_tables_and_no_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert urlrules.url_verdicts(frame(spark, []), none).count() == 0
    assert urlrules.url_verdicts(frame(spark, []), spark.createDataFrame(RULES, none.schema)).count() == 0
    assert [r["verdict"] for r in urlrules.url_verdicts(frame(spark, [(1, "http://net/")]), none, otherwise="block").collect()] == ["block"]


def test_rules_of_any_length_are_an_error(spark):
    with pytest.raises(ValueError, match="labels"):
        urlrules.url_verdicts(frame(spark, [(1, "u")]), spark.createDataFrame([("h", "/" * 5000, "block")], "host string, path string, verdict string"))


def test_a_host_with_all_rows_is_joined_by_url(spark):
    rows = [(i, f"http://hot.example.net/{'en' if i % 3 else 'de'}/{i % 7}") for i in range(5000)]
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, verdict string")
    out = urlrules.url_verdicts(frame(spark, rows), rules)
    assert out.count() == 5000
    assert {(r["rule"], r["verdict"]) for r in out.select("rule", "verdict").distinct().collect()} == {("example.net/en/", "allow"), ("net/", "block")}


def test_the_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = con.sql(urlrules.OP11_SQL).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in urlrules.op11_url_filters(spark, "/root/testdata/sf0.01").collect())
