import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from graphemica.llm import url_filter as u


def judge(spark, urls, outcomes=(), **kw):
    pages = spark.createDataFrame([(i, x, "k") for i, x in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame(list(outcomes), "page_id long, bad int")
    return {r.page_id: r for r in u.url_filter(pages, labels, **kw).collect()}


def test_parts_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "https://example.net/fr/", "x://b.org/fr", "x://b.org/fr/1", "http://example.com/de/1", "http://notexample.com/de/",
        "http://net", "http://net/", "a://b://c/d", "http://ÄB.org?x", "http://h.org#a/b", "http://my.example.net/EN/", "http://x.planet/",
    ]
    got = judge(spark, urls)
    assert [(got[i].host, got[i].path) for i in (0, 1, 2)] == [("", "")] * 3
    assert [(got[3].host, got[3].path, got[3].rule, got[3].verdict)] == [("a.example.net", "/en/x", "example.net/en/", "allow")]
    assert (got[4].rule, got[4].verdict) == ("net/", "block") and got[5].rule is None and got[6].rule == "org/fr/"
    assert got[7].verdict == "block" and got[8].rule is None and got[9].rule is None and got[10].rule == "net/"
    assert (got[11].host, got[11].path) == ("b:", "//c/d") and got[12].host == "Äb.org" and got[13].path == ""
    assert got[14].rule == "net/" and got[15].rule is None


def test_reputation(spark):
    urls = ["http://bad.site.org/"] * 60 + ["http://good.site.com/"] * 60 + ["http://new.site.org/", "http://one.other.com/", "http://new.site.com/", "http://x.else.info/"]
    outcomes = [(i, 1) for i in range(60)] + [(60 + i, 0) for i in range(60)] + [(121, 1), (None, 1), (5, None), (99999, 1)]
    got = judge(spark, urls, outcomes)
    assert got[0].verdict == "block" and got[60].verdict == "allow"
    # a host without outcomes has what its domain says: all bad, all good; or what the suffixes say together
    assert got[120].verdict == "block" and got[122].verdict == "allow" and got[123].verdict == "allow"
    assert got[60].risk < got[122].risk < got[123].risk < got[121].risk < got[0].risk  # shrunk towards domain and suffix
    hosts = spark.createDataFrame([("a.x.co.uk", 1), ("a.x.co.uk", 0), ("b.x.co.uk", 0), ("com", 1), ("", 0), ("n.x.co.uk", None)], "host string, bad int")
    rep = {r.host: r for r in u.host_reputation(hosts).collect()}
    assert all(0 <= r.mean <= 1 and 0 <= r.risk <= 1 for r in rep.values()) and rep["a.x.co.uk"].n == 2 and rep["n.x.co.uk"].n == 0
    assert {r.verdict for r in judge(spark, urls).values()} == {"allow"}  # no outcome at all


def test_domains(spark):
    hosts = ["a.b.x.co.uk", "com", "a.b", "user:pw@a.b.org:8080", "10.0.0.1", "10.0.0.1:99", "[::1]:80", "w.example.com.", ""]
    want = [("x.co.uk", "co.uk"), ("com", "com"), ("a.b", "b"), ("b.org", "org"), ("10.0.0.1", "#"), ("10.0.0.1", "#"), ("[::1]", "#"), ("example.com", "com"), ("", "")]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert [tuple(r) for r in df.select(u.domain_of(F.col("host")), u.suffix_of(F.col("host"))).collect()] == want
    assert df.select(u.domain_of(F.col("host"), ("b.org",))).collect()[3][0] == "a.b.org"


def test_chance_below_is_the_beta_distribution(spark):
    """For whole parameters the distribution is a sum of binomial terms, exact in fractions."""
    cases = [(a, b) for a in (1, 2, 3, 7, 40, 300) for b in (1, 2, 5, 60, 900)] + [(1200, 4600), (900, 4100)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double")
    got = u.with_chance_below(df, F.col("a"), F.col("b"), 0.2, "p").collect()
    for r, (a, b) in zip(got, cases):
        n = a + b - 1
        want = float(sum(math.comb(n, k) * 4 ** (n - k) for k in range(a, n + 1)) / Fraction(5**n))
        assert abs(r.p - want) < 1e-8, (a, b, r.p, want)
    odd = spark.createDataFrame([(0.5, 0.5), (0.0, 3.0), (3.0, 0.0), (2e8, 9e8), (2.2e8, 7.8e8), (0.01, 0.99)], "a double, b double")
    p = [r.p for r in u.with_chance_below(odd, F.col("a"), F.col("b"), 0.2, "p").collect()]
    assert abs(p[0] - 2 / math.pi * math.asin(math.sqrt(0.2))) < 1e-8 and p[1] == 1 and p[2] == 0 and p[3] > 0.999 and p[4] < 0.001 and 0.97 < p[5] < 1


def plain_verdicts(urls, outcomes):
    """The levels by hand, with the distribution summed numerically."""
    host = [u_.split("://")[1].split("/")[0] for u_ in urls]
    bad = dict(outcomes)
    count = lambda key: {k: (sum(bad[i] for i in range(len(urls)) if i in bad and key(host[i]) == k), sum(i in bad for i in range(len(urls)) if key(host[i]) == k)) for k in set(map(key, host))}
    levels = [count(lambda h: h.split(".")[-1]), count(lambda h: ".".join(h.split(".")[-2:])), count(lambda h: h)]

    def strength(level):
        seen = [(b, n) for b, n in level.values() if n]
        mean = sum(b for b, _ in seen) / sum(n for _, n in seen)
        rates = [b / n for b, n in seen]
        spread = sum(r * r for r in rates) / len(rates) - (sum(rates) / len(rates)) ** 2 - mean * (1 - mean) * sum(1 / n for _, n in seen) / len(seen)
        return min(max(mean * (1 - mean) / spread - 1 if spread > 0 else u.STRONGEST, u.WEAKEST), u.STRONGEST), mean

    (ks, m0), (kd, _), (kh, _) = map(strength, levels)
    shrink = lambda pair, k, m: (pair[0] + k * m) / (pair[1] + k)
    out = []
    for h in host:
        s = shrink(levels[0][h.split(".")[-1]], ks, m0)
        d = shrink(levels[1][".".join(h.split(".")[-2:])], kd, s)
        b, n = levels[2][h]
        a, z = b + kh * d, n - b + kh * (1 - d)
        t = [(i + 0.5) / 20000 for i in range(20000)]
        w = [math.exp((a - 1) * math.log(x) + (z - 1) * math.log(1 - x)) for x in t]
        out.append("block" if sum(w[4000:]) / sum(w) > u.SURE else "allow")
    return out


def test_verdicts_equal_the_levels_by_hand(spark):
    rnd = random.Random(3)
    rate = {}
    urls, outcomes = [], []
    for i in range(1500):
        domain = f"d{rnd.randrange(12)}.{rnd.choice(['com', 'info', 'dev'])}"
        host = f"h{rnd.randrange(4)}.{domain}"
        base = rate.setdefault(domain, rnd.betavariate(1, 2))
        urls.append(f"http://{host}/x")
        if rnd.random() < 0.6:
            outcomes.append((i, int(rnd.random() < base)))
    got = judge(spark, urls, outcomes)
    want = plain_verdicts(urls, outcomes)
    assert [got[i].verdict for i in range(len(urls))] == want and len(set(want)) == 2


def test_empty_and_repeats(spark):
    assert judge(spark, []) == {}
    got = judge(spark, ["http://a.b/x"] * 2 + ["http://" + "y" * 100_000 + ".net/"], [(0, 1), (0, 1)])
    assert got[0].verdict == got[1].verdict and got[2].rule == "net/"
