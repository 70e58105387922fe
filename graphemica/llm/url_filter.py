"""URL filters: explicit rules first, then empirical-Bayes host reputation.  DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix.  Each level is a
beta-binomial: its prior mean is the posterior mean of the level above (suffix under the whole table, domain
under suffix, host under domain), its prior strength comes from the spread of that level's rates by the
method of moments.  A host without outcomes has its domain's rate as its own, and a domain or suffix without any has
what is above it.  A host is blocked when its bad rate is over a limit with a posterior probability of more than
SURE, that is, when the lower bound of the rate (a quantile of its beta distribution) is over the limit.

Plan: outcomes are pre-aggregated to one row per host, written once to the shared folder; the levels above are
aggregates of that table.  Pages meet the host table by an equi-join on host: Spark broadcasts it only if its
measured size is under the session's threshold, and otherwise splits a host that holds a third of the pages.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphemica.llm.buckets import materialize

#: (verdict, rule): a rule is a host, a slash and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Public suffixes of two labels; any other suffix is the last label.  A longer list is a parameter.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn",
    "go.jp", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "nhs.uk", "or.jp", "or.kr", "org.au",
    "org.br", "org.cn", "org.in", "org.mx", "org.nz", "org.uk", "org.za", "sch.uk",
)
#: The rate that a host may have; how sure it must be that it has more.
LIMIT, SURE = 0.2, 0.95
#: Strength of a prior in pages, at least and at most.
WEAKEST, STRONGEST = 1.0, 1000.0
#: The suffix of all addresses that are numbers.
NUMERIC = "#"


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); else both empty."""
    parts = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "path": F.regexp_extract(url, parts, 2),
    })


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    return ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))


def _first_fit(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null.  The rules are a bounded list."""
    rule = verdict = F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        rule, verdict = F.when(_fits(r), r).otherwise(rule), F.when(_fits(r), what).otherwise(verdict)
    return rule, verdict


def bare_host(host: Column) -> Column:
    """The host without user, port and a last dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "[.]?(:[0-9]*)?$", "")


def _numeric(bare: Column) -> Column:
    return bare.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$") | F.startswith(bare, F.lit("["))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    bare = bare_host(host)
    last2, last = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)
    return F.when(_numeric(bare), NUMERIC).when(last2.isin(*suffixes), last2).otherwise(last)


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix and one label more; a host that is only a suffix, or a number, is its own domain."""
    bare = bare_host(host)
    last2 = F.substring_index(bare, ".", -2)
    return F.when(_numeric(bare), bare).when(last2.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(last2)


def _log_gamma(z: Column) -> Column:
    """Stirling's series eight steps up, where it is exact to ten digits."""
    w, below = z + 8, z
    for k in range(1, 8):
        below = below * (z + k)
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w) - F.log(below)


def with_chance_below(df: DataFrame, a: Column, b: Column, limit: float, name: str) -> DataFrame:
    """Add the probability that a Beta(a, b) variable is under ``limit``: the regularised incomplete beta function, by
    its continued fraction from the far end.  A parameter of 0 puts all weight on 0 or 1."""
    swap = F.lit(limit) >= (F.col("__a") + 1) / (F.col("__a") + F.col("__b") + 2)
    side = df.withColumns({"__a": a, "__b": b}).withColumns({
        "__p": F.when(swap, F.col("__b")).otherwise(F.col("__a")), "__q": F.when(swap, F.col("__a")).otherwise(F.col("__b")),
        "__x": F.when(swap, F.lit(1 - limit)).otherwise(F.lit(limit)), "__swap": swap,
    })
    p, q, x = (F.col(c) for c in ("__p", "__q", "__x"))

    def step(t: Column, j: Column) -> Column:
        m = F.floor(j / 2)
        d = F.when(j % 2 == 0, m * (q - m)).otherwise(-(p + m) * (p + q + m))
        return d * x / ((p + j - 1) * (p + j)) / (1 + t)

    fraction = F.aggregate(F.sequence((F.lit(60) + 8 * F.ceil(F.sqrt(p + q))).cast("int"), F.lit(1), F.lit(-1)), F.lit(0.0), step)
    scale = F.exp(p * F.log(x) + q * F.log(1 - x) + _log_gamma(p + q) - _log_gamma(p + 1) - _log_gamma(q))
    value = F.least(F.greatest(scale / (1 + fraction), F.lit(0.0)), F.lit(1.0))
    below = F.when(F.col("__a") <= 0, 1.0).when(F.col("__b") <= 0, 0.0).when(F.col("__swap"), 1 - value).otherwise(value)
    return side.withColumn(name, below).drop("__a", "__b", "__p", "__q", "__x", "__swap")


def _strength(counts: DataFrame) -> Column:
    """Prior strength and mean of a level, as a scalar subquery.  With rates of variance v around the mean m and a mean sampling
    part s = m (1 - m) * avg(1 / n), method of moments gives m (1 - m) / (v - s) - 1, kept within bounds."""
    mean = F.col("b") / F.col("t")
    s = counts.agg(F.sum("bad").alias("b"), F.sum("n").alias("t"), F.avg(1 / F.col("n")).alias("inv"), F.avg((F.col("bad") / F.col("n")) * (F.col("bad") / F.col("n"))).alias("sq"), F.avg(F.col("bad") / F.col("n")).alias("m1"))
    spread = F.col("sq") - F.col("m1") * F.col("m1") - mean * (1 - mean) * F.col("inv")
    m = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(STRONGEST)
    k = F.coalesce(F.least(F.greatest(m, F.lit(WEAKEST)), F.lit(STRONGEST)), F.lit(WEAKEST))
    return s.select(F.struct(k.alias("k"), F.coalesce(mean, F.lit(0.0)).alias("mean"))).scalar()


def host_reputation(outcomes: DataFrame, *, limit: float = LIMIT, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """outcomes: host, bad (0, 1, or null for a page without an outcome).  A row per host: host, n, bad, mean (of the
    posterior bad rate) and risk (the posterior probability that the rate is over ``limit``)."""
    hosts = outcomes.where("host is not null").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes_ = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top, mid, own = (_strength(x.where("n > 0")) for x in (suffixes_, domains, hosts))
    shrink = lambda mean, k: (F.col("bad") + k * mean) / (F.col("n") + k)
    s = suffixes_.select("suffix", shrink(top["mean"], top["k"]).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("domain", "suffix", shrink(F.col("suffix_mean"), mid["k"]).alias("domain_mean"))
    h = hosts.join(d, ["suffix", "domain"]).select("host", "n", "bad", "domain_mean", own["k"].alias("k"))
    a, b = F.col("bad") + F.col("k") * F.col("domain_mean"), F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("domain_mean"))
    told = with_chance_below(h, a, b, limit, "below")
    return told.select("host", "n", "bad", (a / (F.col("n") + F.col("k"))).alias("mean"), (1 - F.col("below")).alias("risk"))


def url_filter(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT, sure: float = SURE, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Judge every page by its url: page id, host, path, rule, verdict, risk (that the host's bad rate is over ``limit``).

    ``outcomes`` has the id column and ``bad`` (0, 1 or null); ids without a page and repeated labels of an
    id count as given; null ids and null outcomes don't count.  The longest rule that fits decides (of equally long
    ones the last in the order of their text); without one, the verdict is block where ``risk > sure``, else allow.
    Defined cases: a null url or one without ``://`` has an empty host and path and is one host like any other; hosts
    without outcomes are judged by what their domain and suffix say, which is nothing where there are no outcomes at
    all: they are allowed; very long urls are read whole; repeated pages are judged alike; empty tables give no rows.
    Other columns of either table are ignored.
    """
    judged = with_host_and_path(pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url")))
    rule, verdict = _first_fit(rules)
    labels = outcomes.select(F.col(f"`{id_col}`").alias("page"), F.col("bad").cast("int").alias("bad")).where("bad is not null and page is not null")
    seen = judged.select("page", "host").join(labels, "page", "left").select("host", "bad")
    known = host_reputation(seen, limit=limit, suffixes=suffixes).select("host", "risk")
    out = judged.withColumns({"rule": rule, "v": verdict}).join(known, "host", "left")
    return out.select(F.col("page").alias(id_col), "host", "path", "rule", F.coalesce("v", F.when(F.col("risk") > sure, "block").otherwise("allow")).alias("verdict"), "risk")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Outcomes: labels by doc_id as page_id; a page is bad if toxic or of low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), 0).alias("bad"))
    return url_filter(pages, outcomes).drop("risk")


_SUFFIX_SQL = "('" + "', '".join(SUFFIXES) + "')"
_STRENGTH_SQL = """SELECT coalesce(least(greatest(CASE WHEN sq - m1 * m1 - p * (1 - p) * inv > 0 THEN p * (1 - p) / (sq - m1 * m1 - p * (1 - p) * inv) - 1
    ELSE {most} END, {least}), {most}), {least}) AS k, coalesce(p, 0) AS p
  FROM (SELECT sum(bad) / sum(n) AS p, avg(1 / n) AS inv, avg((bad / n) * (bad / n)) AS sq, avg(bad / n) AS m1 FROM {table})"""
_BARE = r"regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', '')"
_STEP_SQL = """CASE WHEN j % 2 = 0 THEN (j / 2) * (q - j / 2) ELSE -(p + (j - 1) / 2) * (p + q + (j - 1) / 2) END * x / ((p + j - 1) * (p + j)) / (1 + t)"""
SQL = rf"""
WITH j AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), seen AS (
  SELECT j.host, CASE WHEN toxic = 1 OR quality = 0 THEN 1.0::DOUBLE WHEN toxic IS NOT NULL AND quality IS NOT NULL THEN 0.0::DOUBLE END AS bad
  FROM j LEFT JOIN labels ON j.page_id = labels.doc_id
), h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0.0) AS bad, {_BARE} AS bare, string_split(bare, '.') AS l FROM seen GROUP BY host
), h AS (
  SELECT host, n, bad, array_to_string(l[-2:], '.') IN {_SUFFIX_SQL} AS two, regexp_matches(bare, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') OR starts_with(bare, '[') AS num,
    CASE WHEN num THEN bare WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
    CASE WHEN num THEN '{NUMERIC}' WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h0
), d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL
), ks AS ({_STRENGTH_SQL.format(table="s WHERE n > 0", most=STRONGEST, least=WEAKEST)}
), kd AS ({_STRENGTH_SQL.format(table="d WHERE n > 0", most=STRONGEST, least=WEAKEST)}
), kh AS ({_STRENGTH_SQL.format(table="h WHERE n > 0", most=STRONGEST, least=WEAKEST)}
), sm AS (SELECT suffix, (bad + k * p) / (n + k) AS m FROM s, ks
), dm AS (SELECT suffix, domain, (bad + k * m) / (n + k) AS m FROM d JOIN sm USING (suffix), kd
), ab AS (SELECT host, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM h JOIN dm USING (suffix, domain), kh
), pq AS (
  SELECT host, a, b, {LIMIT} >= (a + 1) / (a + b + 2) AS swap, CASE WHEN swap THEN b ELSE a END AS p, CASE WHEN swap THEN a ELSE b END AS q, CASE WHEN swap THEN 1 - {LIMIT} ELSE {LIMIT} END::DOUBLE AS x FROM ab
), risk AS (
  SELECT host, CASE WHEN a <= 0 THEN 0.0 WHEN b <= 0 THEN 1.0 ELSE (
    SELECT CASE WHEN swap THEN v ELSE 1 - v END FROM (SELECT
      exp(p * ln(x) + q * ln(1 - x) + lgamma(p + q) - lgamma(p + 1) - lgamma(q)) /
      (1 + list_reduce(list_concat([0.0::DOUBLE], list_transform(range((60 + 8 * ceil(sqrt(p + q)))::BIGINT, 0, -1), lambda i: i::DOUBLE)), lambda t, j: {_STEP_SQL})) AS v)) END AS risk FROM pq
), r AS (
  SELECT j.*, risk,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM j LEFT JOIN risk USING (host)
)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
       ELSE CASE WHEN risk > {SURE} THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
