"""URL filters: host reputation by empirical Bayes.

Labelled page outcomes (bad or not) are counted for each host and shrunk
through beta-binomial priors: the whole table to the suffix, the suffix to the
registered domain, the domain to the host; the priors' means and strengths
both come from the counts. A page is blocked where a lower
bound of its host's posterior bad rate lies above a limit; fixed rules by host
and path come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host and path, verdict).
RULES: tuple[tuple[str, str], ...] = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Suffixes of two labels below which a domain is registered.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za")
#: Pseudo-counts that a parent's rate weighs at the level below (suffix,
#: domain, host) where the counts say nothing, and the bounds of what they say.
STRENGTH = (50.0, 20.0, 10.0)
WEAKEST, STRONGEST = 1.0, 1000.0
#: Blocked if the posterior mean less Z standard deviations exceeds LIMIT.
Z, LIMIT = 1.645, 0.25


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null. Ties go to the alphabetical first."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def site_of(host: Column) -> Column:
    """The host without user and port, for the levels only."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _weigh(counts: DataFrame, default: float) -> DataFrame:
    """``counts`` (n, bad, prior, ..) with ``strength``: how alike one prior's children are, by moments.

    The squared error of beta-binomial counts is v + (n - 1) v / (strength + 1)
    with v = n prior (1 - prior); both sides are summed over all children, in
    one aggregate, whose single row goes back to each.
    """
    v = F.col("n") * F.col("prior") * (1 - F.col("prior"))
    error = F.col("bad") - F.col("n") * F.col("prior")
    sums = counts.agg(F.sum(error * error - v).alias("over"), F.sum((F.col("n") - 1) * v).alias("room"))
    said = F.round(F.col("room") / F.col("over") - 1, 3)
    strength = F.when(F.coalesce(F.col("room"), F.lit(0.0)) <= 0, default).when(F.col("over") <= 0, STRONGEST).otherwise(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), said)))
    return counts.crossJoin(F.broadcast(sums.select(strength.alias("strength"))))  # one row


def host_reputation(outcomes: DataFrame, strength=STRENGTH) -> DataFrame:
    """``outcomes`` (host, n, bad: counts a host) to (host, mean, sd).

    Each level's rate is its own counts plus pseudo-counts at its parent's
    posterior rate; how many is estimated from the level's counts, or is
    ``strength`` where they say nothing. Hosts without labels have their
    domain's rate. Users and ports do not part a domain. Levels join by key;
    each is an aggregate of the one below, never larger.
    """
    h = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    h = h.withColumn("site", site_of(F.col("host"))).withColumns({"domain": domain_of(F.col("site")), "suffix": suffix_of(F.col("site"))}).drop("site")
    d = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    root = s.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("prior"))
    rate = (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))
    s = _weigh(s.crossJoin(F.broadcast(root)), strength[0]).select("suffix", rate.alias("prior"))  # one row
    d = _weigh(d.join(s, "suffix"), strength[1]).select("domain", rate.alias("prior"))
    h = _weigh(h.join(d, "domain"), strength[2])
    a = F.col("bad") + F.col("strength") * F.col("prior")
    total = F.col("n") + F.col("strength")
    return h.select("host", (a / total).alias("mean"), F.sqrt(a * (total - a) / (total * total * (total + 1.0))).alias("sd"))


def filter_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, z: float = Z, limit: float = LIMIT, salt_rows: int = 1_000_000) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, and the bound.

    ``labels``: (page_id, bad) for some pages; labels of no page, with a null
    id or a null outcome count for nothing; of several for one page the worst
    counts. A null url, or one without ``://``,
    has empty host and path and the reputation of the empty host. Repeated
    pages get equal rows. With no labels the root rate is a half, and its
    bound, under the priors' strength, is what unlabelled hosts are held to.

    A host's pages are dealt by (host, salt): salts follow the host's row
    count, so a host with a third of all pages is split.
    """
    p = pages.select(F.col(page_id), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).drop("url")
    known = labels.select(F.col(labels.columns[0]).alias("__id"), F.col(labels.columns[1]).cast("int").alias("__bad")).filter("__bad is not null").groupBy("__id").agg(F.max("__bad").alias("__bad"))
    hits = p.join(known, F.col(page_id) == F.col("__id"), "left").groupBy("host").agg(F.count("__bad").alias("n"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("rows"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("rows") / salt_rows)).cast("int")
    rated = host_reputation(hits).join(hits.select("host", salts.alias("salts")), "host")
    spread = rated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    most = F.broadcast(hits.agg(F.max(salts).alias("most")))  # one row
    dealt = p.crossJoin(most).withColumn("salt", F.pmod(F.xxhash64(F.col(page_id)), F.col("most")).cast("int"))
    # A salt beyond the host's own number wraps round to one that it has.
    dealt = dealt.join(F.broadcast(rated.filter("salts > 1").select("host", F.col("salts").alias("own"))), "host", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("own").isNull(), 0).otherwise(F.pmod(F.col("salt"), F.col("own"))))
    bound = F.col("mean") - z * F.col("sd")
    rule = F.col("rule")
    fixed = None
    for text, said in rules:
        fixed = F.when(rule == text, said) if fixed is None else fixed.when(rule == text, said)
    verdict = F.when(bound > limit, "block").otherwise("allow")
    return (
        dealt.join(spread.select("host", "salt", "mean", "sd"), ["host", "salt"])
        .withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
        .select(page_id, "host", "path", "rule", (verdict if fixed is None else F.coalesce(fixed, verdict)).alias("verdict"), F.round(F.col("mean"), 6).alias("bad_rate"), F.round(bound, 6).alias("bad_bound"))
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``.

    A page is bad if the labels call its document toxic or of low quality; of
    several labels the worst counts. Null urls have empty host and path.
    Repeated rows repeat; rules of one length tie by their text. No pages, no
    rows.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels)
