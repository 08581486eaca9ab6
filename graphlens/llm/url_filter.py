"""Host reputation by empirical Bayes, with allow and block rules on top.

A page that a rule fits is a labelled outcome (block: bad, allow: good). Bad rates are shrunk down the tree of names with
beta-binomial priors: all pages -> suffix -> registered domain -> host. The prior of a level has the posterior mean of the
level above and a strength that the spread of the level's own rates gives (method of moments). A page of no rule is
blocked when the lower bound of its host's posterior bad rate is at least `times` the rate of all labelled pages, so a
host needs evidence, its own or its domain's, that it is clearly worse than the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, narrow_side, table

#: (verdict, rule); the longest rule that fits decides.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Second labels that make a suffix together with a country's two letters.
SECOND = "ac|co|com|edu|go|gov|ne|net|or|org"
_IP = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$"
_SUFFIX = rf"(?:^|\.)((?:{SECOND})\.[a-z]{{2}}|[^.]*)$"
_DOMAIN = rf"(?:^|\.)([^.]*\.(?:{SECOND})\.[a-z]{{2}}|[^.]*\.[^.]*)$"


def host_and_path(url: Column) -> Column:
    """struct(host, path). Host: after the first :// up to / ? # or the end, A-Z lowered; path: then up to ? # or the end."""

    def split(rest: Column) -> Column:
        host = F.regexp_extract(rest, "^[^/?#]*", 0)
        return F.struct(ascii_lower(host).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))

    at = F.instr(url, "://")
    return let(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit("")), split)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one wraps the others
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_name(host: Column) -> Column:
    """A host without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "(:[0-9]*|\\.+)+$", "")


def suffix_and_domain(name: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host name; an address is both, and so is a name of one label."""
    own = lambda p: F.when(name.rlike(_IP), name).otherwise(F.coalesce(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), name))
    return own(_SUFFIX), own(_DOMAIN)


def _strength(level: DataFrame, parent_mean: str) -> float:
    """Prior strength from the spread of rates around their parents' means, between 1 and 1000."""
    m = F.col(parent_mean)
    r = level.where("n > 0").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2)).alias("ss"),
        F.sum(F.col("n") * m * (1 - m)).alias("within"),
    ).first()
    if not r["n"] or r["k"] < 2:
        return 1000.0
    within = r["within"] / r["n"]
    between = max(0.0, (r["ss"] - r["k"] * within) / r["n"])
    return min(1000.0, max(1.0, within / between - 1)) if between > 0 else 1000.0


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, float]:
    """outcomes(host, labelled, bad) of each page -> (one row per host name: name, n, bad, mean, low; the rate of all pages).

    Names without labelled pages take their domain's rate; an empty host counts under an empty domain and suffix.
    """
    labelled = F.col("labelled")
    suffix, domain = suffix_and_domain(F.col("name"))
    host = outcomes.groupBy(host_name(F.col("host")).alias("name")).agg(F.count_if(labelled).alias("n"), F.count_if(labelled & F.col("bad")).alias("bad"))
    host = materialize(host.withColumns({"domain": domain, "suffix": suffix}))
    total = host.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    m0 = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = host.groupBy("suffix").agg(*sums).withColumn("m0", F.lit(m0))
    k = _strength(suffix, "m0")
    suffix = suffix.select("suffix", ((F.col("bad") + k * F.col("m0")) / (F.col("n") + k)).alias("suffix_mean"))
    domain = host.groupBy("suffix", "domain").agg(*sums).join(narrow_side(suffix), "suffix")
    k = _strength(domain, "suffix_mean")
    domain = domain.select("domain", ((F.col("bad") + k * F.col("suffix_mean")) / (F.col("n") + k)).alias("domain_mean"))
    full = host.join(narrow_side(domain), "domain")
    k = _strength(full, "domain_mean")
    a, b = F.col("bad") + k * F.col("domain_mean"), F.col("n") - F.col("bad") + k * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    return full.select("name", "n", "bad", mean.alias("mean"), (mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("low")), m0


def filter_urls(pages: DataFrame, rules=RULES, times: float = 1.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, bad_low (the bound of the host's bad rate) for each row of pages.

    A null url, or one without ://, has an empty host and path; such pages share one reputation and no rule fits them.
    Repeated rows each get their own result; null ids pass through. An empty table gives an empty result; other columns of
    pages are not looked at. Without labelled pages nothing is blocked.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host_and_path(F.coalesce(F.col(url_col), F.lit(""))).alias("p")).select("page_id", "p.host", "p.path")
    ruled = parts.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.col("r.verdict")
    known, average = host_reputation(ruled.select("host", verdict.isNotNull().alias("labelled"), F.coalesce(verdict == "block", F.lit(False)).alias("bad")), z)
    out = ruled.withColumn("name", host_name(F.col("host"))).join(narrow_side(known.select("name", F.col("low").alias("bad_low"))), "name", "left")
    method = F.when(F.col("bad_low") >= times * average, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_low")


def op3_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages")).drop("bad_low")


def _sql(rules=RULES, times: float = 1.5, z: float = 1.645) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def case(value) -> str:
        def fits(rule):
            name, _, start = rule.partition("/")
            return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}')"

        return "CASE " + " ".join(f"WHEN {fits(rule)} THEN '{value(verdict, rule)}'" for verdict, rule in ordered) + " END"

    def strength(level: str, mean: str) -> str:
        return f"""SELECT CASE WHEN count(*) < 2 THEN 1000.0 WHEN (sum(n * power(bad / n - {mean}, 2)) - count(*) * (sum(n * {mean} * (1 - {mean})) / sum(n))) <= 0 THEN 1000.0
 ELSE least(1000.0, greatest(1.0, (sum(n * {mean} * (1 - {mean})) / sum(n)) / ((sum(n * power(bad / n - {mean}, 2)) - count(*) * (sum(n * {mean} * (1 - {mean})) / sum(n))) / sum(n)) - 1)) END::DOUBLE AS k FROM {level} WHERE n > 0"""

    own = lambda p: f"CASE WHEN regexp_matches(name, '{_IP}') THEN name ELSE coalesce(nullif(regexp_extract(name, '{p}', 1), ''), name) END"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS ruled, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*|\\.+)+$', '') AS name FROM p),
h AS (SELECT name, {own(_DOMAIN)} AS domain, {own(_SUFFIX)} AS suffix, count(ruled)::DOUBLE AS n, count(*) FILTER (ruled = 'block')::DOUBLE AS bad FROM r GROUP BY name),
m AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m0 FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m0) AS m0 FROM h, m GROUP BY suffix),
sk AS ({strength("s", "m0")}),
s2 AS (SELECT suffix, (bad + k * m0) / (n + k) AS sm FROM s, sk),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(sm) AS sm FROM h JOIN s2 USING (suffix) GROUP BY ALL),
dk AS ({strength("d", "sm")}),
d2 AS (SELECT domain, (bad + k * sm) / (n + k) AS dm FROM d, dk),
f AS (SELECT name, n, bad, dm FROM h JOIN d2 USING (domain)),
fk AS ({strength("f", "dm")}),
ab AS (SELECT name, bad + k * dm AS a, n - bad + k * (1 - dm) AS b FROM f, fk),
lo AS (SELECT name, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN low >= {times} * m0 THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN lo USING (name), m
""".replace("\\\\", "\\")


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {"op3_url_filter": _sql()}
