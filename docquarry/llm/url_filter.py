"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Outcomes of pages are shrunk through beta-binomial priors along suffix,
registered domain and host: the prior of a level is the posterior mean of the
level above it with a strength that is fitted, by moments, to how far groups of
the level differ. An url is blocked when the upper bound of its good rate, the
beta posterior's quantile at ``Z`` (by a closed form, good to 0.001 where both
parameters reach 5), lies below ``GOOD_RATE``: a host must have earned a bad
name before its pages go.

A page's outcome is its own: labels given by page, or the judgement of
``good_page`` on its markup (enough words, few symbols, few repeated windows
of three words). Levels are of the host without user and port; the suffix is the last
label, or two where the second is a generic one under a country ("co.uk"), and
an address of numbers is a level by itself.

Everything is built-in Spark SQL. Hosts are counted before any join, so a host
with a third of all pages is one row; the page side of the host join is dealt
by the page, with the reputation table broadcast only if its counted rows are
few, and salted by page otherwise.

Cases: a null url, or one without ``://``, has empty host and path; a host
without labelled pages falls back to its domain, suffix or the root prior; null
labels and labels without a page are not counted; several labels of one page
are several outcomes; repeated pages give repeated rows; extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import common

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A host of which surely less than this share of pages is good is blocked.
GOOD_RATE = 0.5
Z = 1.645
#: A good page: words at least, symbols per 100 words at most, distinct windows of three words per 100 at least.
MIN_WORDS, MOST_SYMBOLS, LEAST_DISTINCT = 50, 10, 50
MARKUP = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|<[^>]*(?:>|\z)"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]"
#: Hosts with a suffix of two labels, and hosts that are addresses.
LONG_SUFFIX = r"\.(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$"
ADDRESS = r"^(\[.*|[0-9.]+)$"
#: Limits of a level's fitted prior strength.
STRENGTH = (2.0, 200.0)
BROADCAST_HOSTS = 200_000
SALTS = 32


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def good_page(html: Column) -> Column:
    """1 or 0 by the page's own text; null without markup."""
    words = F.filter(F.split(F.regexp_replace(html, MARKUP, " "), SPACES), lambda w: w != "")

    def judged(w: Column) -> Column:
        symbols = F.aggregate(w, F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, SYMBOLS, "")))
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        distinct = F.size(F.array_distinct(windows)) * 100 >= LEAST_DISTINCT * (F.size(w) - 2)
        return F.when((F.size(w) >= MIN_WORDS) & (symbols * 100 <= MOST_SYMBOLS * F.size(w)), distinct).otherwise(F.lit(False)).cast("long")

    return F.when(html.isNotNull(), common.let(words, judged))


def with_levels(df: DataFrame) -> DataFrame:
    """Adds site (host without user and port), suffix, and domain (one label more)."""
    df = df.withColumn("site", F.regexp_replace(F.regexp_replace("host", "(?s)^.*@", ""), ":[0-9]*$", ""))
    labels = lambda n: F.when(F.col("site").rlike(ADDRESS), F.col("site")).when(F.col("site").rlike(LONG_SUFFIX), F.substring_index("site", ".", -n - 1)).otherwise(F.substring_index("site", ".", -n))
    return df.withColumn("suffix", labels(1)).withColumn("domain", labels(2))


def upper_bound(a: str, b: str, z: float = Z) -> str:
    """SQL of the quantile at ``z`` of a beta distribution (Abramowitz and Stegun 26.5.22), or of the normal one where a parameter is 1 at most."""
    part, h, rate = (z * z - 3) / 6, f"(2 / (1 / (2 * {a} - 1) + 1 / (2 * {b} - 1)))", f"({a} / ({a} + {b}))"
    w = f"(- {z!r} * sqrt({h} + ({part!r})) / {h} - (1 / (2 * {b} - 1) - 1 / (2 * {a} - 1)) * ({part + 5 / 6!r} - 2 / (3 * {h})))"
    return f"(case when least({a}, {b}) > 1 then {a} / ({a} + {b} * exp(2 * {w})) else least(1, {rate} + {z!r} * sqrt({rate} * (1 - {rate}) / ({a} + {b} + 1))) end)"


def _strength(groups: DataFrame) -> float:
    """The prior strength of a level, from its rows of (n, good, parent_rate).

    Under a beta-binomial, the squared errors (good - n m)^2 / (m (1 - m)) have
    mean n + rho n (n - 1), with rho = 1 / (strength + 1).
    """
    n, m = F.col("n"), F.col("parent_rate")
    error = (F.col("good") - n * m) * (F.col("good") - n * m) / (m * (1 - m))
    q, total, pairs = groups.agg(F.sum(error), F.sum("n"), F.sum(n * (n - 1))).first()
    rho = (q - total) / pairs if pairs else 0.0
    return 1 / min(1 / (STRENGTH[0] + 1), max(1 / (STRENGTH[1] + 1), rho)) - 1


def reputation(outcomes: DataFrame, z: float = Z) -> tuple[DataFrame, tuple[int, float, float]]:
    """(levels, root): site, domain, suffix, n, good, prior_rate, posterior, upper from rows of (host, good 0/1).

    One row for each site with an outcome, and rows for the levels above it:
    (null, domain, suffix) and (null, null, suffix). The root is one triple
    (n, posterior, upper); only it and one number a level come to the driver.
    """
    counts = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = with_levels(outcomes).groupBy("site", "domain", "suffix").agg(F.count("good").alias("n"), F.sum("good").alias("good")).filter("n > 0")
    hosts = common.cut(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    n, good = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()

    def level(groups: DataFrame) -> DataFrame:
        """Adds alpha, beta and rate: the parent's rate as prior, with the level's strength."""
        k, m = F.lit(_strength(groups)), F.col("parent_rate")
        found = groups.withColumn("alpha", m * k + F.col("good")).withColumn("beta", (1 - m) * k + F.col("n") - F.col("good"))
        return found.withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))

    def bound(alpha: float, beta: float) -> float:
        return outcomes.sparkSession.sql(f"select cast({upper_bound(f'cast({alpha!r} as double)', f'cast({beta!r} as double)', z)} as double)").first()[0]

    root = (good + 1.0) / (n + 2.0)
    s = level(suffixes.withColumn("parent_rate", F.lit(root)))
    d = level(domains.join(s.select("suffix", F.col("rate").alias("parent_rate")), "suffix"))
    h = level(hosts.join(d.select("domain", F.col("rate").alias("parent_rate")), "domain"))
    nothing = F.lit(None).cast("string")
    columns = ("site", "domain", "suffix", "n", "good", F.col("parent_rate").alias("prior_rate"), F.col("rate").alias("posterior"), F.expr(upper_bound("alpha", "beta", z)).alias("upper"))
    levels = h.select(*columns)
    levels = levels.unionByName(d.withColumn("site", nothing).select(*columns)).unionByName(s.withColumn("site", nothing).withColumn("domain", nothing).select(*columns))
    return levels, (n, root, bound(good + 1.0, n - good + 1.0))


def judge_urls(pages: DataFrame, outcomes: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", good_rate: float = GOOD_RATE, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, n_host, posterior, upper for each input row.

    ``outcomes`` has page_id and good (1 or 0); without it each page's own
    markup in ``html_col`` tells its outcome (``good_page``). Verdict and rule are the longest
    fitting rule's; without one, "block" if the upper bound of the most specific
    level with outcomes lies below ``good_rate``, else "allow".
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if outcomes is None:
        counted = pages.select(host_of(F.col(url_col).cast("string")).alias("host"), good_page(F.col(html_col).cast("string")).alias("good"))
    else:
        known = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("long").alias("good")).filter("page_id is not null and good is not null")
        counted = base.join(known, "page_id").select("host", "good")
    levels, root = reputation(counted, z)
    levels = common.cut(levels, "reputation")
    value = F.struct("n", "posterior", "upper")
    names = {
        "site": levels.filter("site is not null").select("site", value.alias("at_host")),
        "domain": levels.filter("site is null and domain is not null").select("domain", value.alias("at_domain")),
        "suffix": levels.filter("domain is null and suffix is not null").select("suffix", value.alias("at_suffix")),
    }
    few = levels.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    found = with_levels(base)
    for name, rows in names.items():
        if few:
            found = found.join(F.broadcast(rows), name, "left")
        else:
            salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            found = found.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, [name, "salt"], "left").drop("salt")
    top = F.struct(F.lit(root[0]).cast("long").alias("n"), F.lit(root[1]).alias("posterior"), F.lit(root[2]).alias("upper"))
    best = F.coalesce("at_host", "at_domain", "at_suffix", top)
    found = found.withColumn("rule_found", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("best", best)
    verdict = F.coalesce(F.col("rule_found.verdict"), F.when(F.col("best.upper") < good_rate, "block").otherwise("allow"))
    return found.select(
        "page_id", "host", "path", F.col("rule_found.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce(F.col("at_host.n"), F.lit(0)).cast("long").alias("n_host"), F.round("best.posterior", 9).alias("posterior"), F.round("best.upper", 9).alias("upper"),
    )


def query(spark, sf_dir) -> DataFrame:
    """Every page judged, with the outcomes of all pages by their own markup."""
    return judge_urls(common.table(spark, sf_dir, "pages"))


def _oracle() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in longest]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, longest))
    verdict = " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, longest))
    low, high = 1 / (STRENGTH[1] + 1), 1 / (STRENGTH[0] + 1)

    def level(name: str, rows: str) -> str:
        q = "sum((good - n * m) * (good - n * m) / (m * (1 - m)))"
        return f"""
{name}_in as ({rows}),
{name}_k as (select 1 / least({high!r}::double, greatest({low!r}::double, coalesce(case when sum(n * (n - 1)) > 0 then ({q} - sum(n)) / sum(n * (n - 1)) else 0 end, {low!r}::double))) - 1 as k from {name}_in),
{name}_p as (select {name}_in.*, m * k + good as a, (1 - m) * k + n - good as b, (m * k + good) / (k + n) as rate from {name}_in, {name}_k)"""

    upper = lambda t: f"case when {t}.rate is not null then {upper_bound(f'{t}.a', f'{t}.b')} end"
    labels = lambda n: f"case when regexp_matches(site, '{ADDRESS}') then site when regexp_matches(site, '{LONG_SUFFIX}') then array_to_string(list_slice(string_split(site, '.'), -{n + 1}, -1), '.') else array_to_string(list_slice(string_split(site, '.'), -{n}, -1), '.') end"
    best = lambda f: "coalesce(" + ", ".join(f(t) for t in ("h", "d", "s", "r")) + ")"
    return f"""
with base as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         list_filter(string_split_regex(regexp_replace(html, '{MARKUP}', ' ', 'g'), '{SPACES}'), lambda x: x <> '') as w
  from pages),
sites as (select *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') as site,
                 list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as triples from base),
lv as (select page_id, host, path, site, {labels(1)} as suffix, {labels(2)} as domain, w is not null as judged,
              len(w) >= {MIN_WORDS} and 100 * length(regexp_replace(array_to_string(w, ''), '{SYMBOLS}', '', 'g')) <= {MOST_SYMBOLS} * len(w)
              and 100 * len(triples) >= {LEAST_DISTINCT} * (len(w) - 2) as is_good from sites),
hosts as (
  select site, any_value(domain) as domain, any_value(suffix) as suffix, count(*)::double as n, (count(*) filter (is_good))::double as good
  from lv where judged group by site),
domains as (select domain, any_value(suffix) as suffix, sum(n) as n, sum(good) as good from hosts group by domain),
suffixes as (select suffix, sum(n) as n, sum(good) as good from domains group by suffix),
root_p as (select coalesce(sum(n), 0) as n, coalesce(sum(good), 0) + 1.0::double as a, coalesce(sum(n) - sum(good), 0) + 1.0::double as b,
                  (coalesce(sum(good), 0) + 1.0::double) / (coalesce(sum(n), 0) + 2) as rate from suffixes),
{level("s", "select suffixes.*, root_p.rate as m from suffixes, root_p")},
{level("d", "select domains.*, s_p.rate as m from domains join s_p using (suffix)")},
{level("h", "select hosts.*, d_p.rate as m from hosts join d_p using (domain)")}
select page_id, lv.host as host, path, case {rule.replace("host", "lv.host")} end as rule,
       coalesce(case {verdict.replace("host", "lv.host")} end, case when {best(upper)} < {GOOD_RATE!r} then 'block' else 'allow' end) as verdict,
       coalesce(h.n, 0)::bigint as n_host, round({best(lambda t: t + ".rate")}, 9) as posterior, round({best(upper)}, 9) as upper
from lv left join h_p h on lv.site = h.site left join d_p d on lv.domain = d.domain left join s_p s on lv.suffix = s.suffix cross join root_p r
"""


ORACLE = _oracle()
