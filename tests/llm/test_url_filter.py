import duckdb
import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import url_filter as uf


def test_hosts_paths_and_rules(spark):
    rows = [
        ("http://A.Example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://m.www.example.com/en/1", "m.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://x.com/a", "x.com", "/a", "com/", "allow"), ("https://xcom/a", "xcom", "/a", None, "allow"),
        ("https://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), ("https://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"), ("https://a.net/fr", "a.net", "/fr", None, "allow"), ("https://x.com", "x.com", "", None, "allow"),
        ("https://x.com?a/b", "x.com", "", None, "allow"), (None, "", "", None, "allow"), ("nothing/here", "", "", None, "allow"), ("a://b\nc.com/d\ne", "b\nc.com", "/d\ne", "com/", "allow"), ("x://y://z/w", "y:", "//z/w", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(rows)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = sorted(uf.judge_urls(df, none).collect(), key=lambda g: g.page_id)
    assert [(g.host, g.path, g.rule, g.verdict) for g in got] == [r[1:] for r in rows]
    assert uf.judge_urls(df.limit(0), none).count() == 0


def test_bad_hosts_are_shrunk_and_blocked(spark):
    urls = [(i, f"https://{h}.example.org/p{i}") for i, h in enumerate(["good"] * 60 + ["bad"] * 60 + ["few"] * 2 + ["new"])]
    outcomes = [(i, 0 if "bad" in u or "few" in u else 1) for i, u in urls if "new" not in u] + [(None, 1), (999, 1), (3, None)]
    pages, good = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")
    got = {g.host.split(".")[0]: g for g in uf.judge_urls(pages, good).collect()}
    assert {h: g.verdict for h, g in got.items()} == {"good": "allow", "bad": "block", "few": "allow", "new": "allow"}
    assert got["bad"].posterior < got["few"].posterior < got["new"].posterior < got["good"].posterior
    uf_rows = uf.BROADCAST_HOSTS
    try:
        uf.BROADCAST_HOSTS = 0  # the salted way gives the same
        salted = {g.host.split(".")[0]: g for g in uf.judge_urls(pages, good).collect()}
    finally:
        uf.BROADCAST_HOSTS = uf_rows
    assert salted == got


def test_equals_its_sql(spark):
    sf = "/root/testdata/sf0.1"
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    want = {r[0]: r for r in c.sql(f"select page_id, host, path, rule, verdict, n_host, posterior, upper from ({uf.ORACLE})").fetchall()}
    got = {r.page_id: tuple(r) for r in uf.query(spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, g in got.items():
        assert g[:6] == want[k][:6] and abs(g[6] - want[k][6]) < 2e-9 and abs(g[7] - want[k][7]) < 2e-9


def test_bound_is_a_beta_quantile(spark):
    r = np.random.default_rng(1)
    for a, b in ((5, 5), (17, 9), (40, 6), (200, 30), (3000, 700), (1.5, 8)):
        got = spark.sql(f"select {uf.upper_bound(f'cast({a} as double)', f'cast({b} as double)')}").first()[0]
        assert abs(got - np.quantile(r.beta(a, b, 400_000), 0.95)) < (0.002 if min(a, b) >= 5 else 0.02)


def test_levels(spark):
    hosts = ["a.b.co.uk", "user@a.b.org:80", "10.0.0.1", "10.0.0.1:8080", "org", "", "x.com.au", "co.uk", "[::1]:80", "a.co.net"]
    rows = uf.with_levels(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    assert [(r.site, r.suffix, r.domain) for r in rows] == [
        ("a.b.co.uk", "co.uk", "b.co.uk"), ("a.b.org", "org", "b.org"), ("10.0.0.1",) * 3, ("10.0.0.1",) * 3, ("org",) * 3, ("",) * 3, ("x.com.au", "com.au", "x.com.au"), ("co.uk", "uk", "co.uk"), ("[::1]",) * 3, ("a.co.net", "net", "co.net"),
    ]


def test_outcomes_come_from_the_page_itself(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    html = [
        (1, f"<p>{prose}</p>"), (1, "<p>too short</p>"), (1, f"<script>{prose}</script>"), (1, f"<script>{prose}"), (1, f"<!-- {prose} --><style>{prose}</style>"), (1, "buy now | " * 60),
        (1, "same three words " * 60), (1, ""), (1, None), (None, f"<b\n class='x'>{prose}"),
    ]
    df = spark.createDataFrame([(i, h) for i, h in html], "page_id long, html string")
    assert [r[0] for r in df.select(uf.good_page(F.col("html"))).collect()] == [1, 0, 0, 0, 0, 0, 0, 0, None, 1]


def test_bad_pages_block_their_host(spark):
    """On the test pages with one host's texts replaced by junk: that host goes, and no other."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host = uf.host_of(F.col("url"))
    bad = "m.ththth.example.net"
    assert pages.filter(host == bad).count() > 50
    got = uf.judge_urls(pages.withColumn("html", F.when(host == bad, F.lit("<p>win | win | win</p>")).otherwise(F.col("html"))))
    blocked = {r.host for r in got.filter("rule is null and verdict = 'block'").select("host").distinct().collect()}
    assert blocked == {bad}
    assert not uf.judge_urls(pages).filter("rule is null and verdict = 'block'").count()
