"""URL filters: explicit rules, and empirical-Bayes reputation of hosts for the rest.

Rules are (host, path) pairs such as ``example.net/en/``: a rule fits its host and all subdomains if the path of the
url starts with the rule's; the longest fitting rule decides. Where none fits, the host's share of bad pages decides.
Labelled page outcomes are counted by host; the rate of a host is shrunk to that of its registered domain, that of the
domain to its suffix and that of the suffix to all pages, each through a beta-binomial prior whose strength is
estimated from the spread of the level's rates (method of moments). The posterior of a host's rate is a beta
distribution; its lower bound is the quantile ``tail``, found by summing the density over ``STEPS`` points of its log
odds. A host is blocked if that bound lies above ``lift`` times the rate of all labelled pages: if it is, but for
``tail``, worse than the whole.

Cases: a null url or one without ``://`` has an empty host and path; such pages share one reputation. Hosts without
labels get their domain's prior. No labels at all: the rates are 0 and nothing is blocked. Pages that are repeated
count each time. A page_id with several outcomes counts as bad if one says so; null page ids have no outcome. An
empty table gives no rows. Only page_id and url are read. Very long urls are cut into host and path like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


# The production rules.
RULES = (
    Rule("block", "net/"),
    Rule("allow", "example.net/en/"),
    Rule("block", "example.com/de/"),
    Rule("allow", "org/fr/"),
)
#: Rules become branches of one expression; a longer list belongs in a table to join with.
MOST_RULES = 500


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    rest = after_scheme(F.coalesce("url", F.lit("")))
    return pages.select("page_id", rest.alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column, of) -> Column:
    """``of(rule)`` for the longest rule that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; an expression takes {MOST_RULES}")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        found = F.when(fits(rule, host, path), F.lit(of(rule))).otherwise(found)
    return found


# Public suffixes of two labels under which names are registered.
TWO_LABELS = (
    "ac.at", "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th",
    "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.es", "com.hk", "com.mx", "com.my", "com.ng",
    "com.pe", "com.ph", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gob.mx", "gouv.fr", "gov.au",
    "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "nhs.uk", "or.at", "or.jp", "or.kr", "org.au",
    "org.br", "org.cn", "org.nz", "org.uk", "org.za", "sch.uk",
)
ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"


def bare_host(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix(host: Column) -> Column:
    """The public suffix of a host; addresses have one of their own, ``address``."""
    h, two = bare_host(host), F.substring_index(bare_host(host), ".", -2)
    return F.when(h.rlike(ADDRESS), "address").when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(h, ".", -1))


def domain(host: Column) -> Column:
    """The registered domain of a host: its suffix and the label before it; an address is its own."""
    h, two = bare_host(host), F.substring_index(bare_host(host), ".", -2)
    return F.when(h.rlike(ADDRESS), h).when(two.isin(*TWO_LABELS), F.substring_index(h, ".", -3)).otherwise(two)


#: Points at which a posterior's density is summed.
STEPS = 400


def beta_quantile(a: Column, b: Column, tail: float) -> Column:
    """The quantile ``tail`` of the beta distribution (a, b); 0 or 1 where a or b is not positive.

    Over log odds u the density is proportional to exp(a u) / (1 + exp(u))^(a + b), which has one mode and thin tails;
    it is summed by trapezoids over eight standard deviations and the tails' decay on either side, and inverted between
    two points, where the density is taken as a line.
    """
    spread = F.sqrt((a + b) / (a * b))
    mode = F.log(a / b)
    low = mode - 8 * spread - 20 / a
    step = (16 * spread + 20 / a + 20 / b) / STEPS

    def found(x: Column) -> Column:
        a, b, mode, low, step = (x[n] for n in ("a", "b", "mode", "low", "step"))
        log_odds = lambda u: a * u - (a + b) * F.when(u > 0, u + F.log1p(F.exp(-u))).otherwise(F.log1p(F.exp(u)))
        peak = log_odds(mode)
        points = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.exp(log_odds(low + i * step) - peak))
        return F.element_at(F.transform(F.array(F.struct(points.alias("d"), low.alias("low"), step.alias("step"))), inverted), 1)

    def inverted(x: Column) -> Column:
        total = F.aggregate(x["d"], F.lit(0.0), lambda s, d: s + d)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last"), F.lit(-1.0).alias("at"), F.lit(0).alias("i"))

        def walk(s: Column, d: Column) -> Column:
            gain = (s["last"] + d) / 2
            over = (s["at"] < 0) & (s["sum"] + gain >= tail * total)
            rest = tail * total - s["sum"]
            root = F.sqrt(F.greatest(s["last"] * s["last"] + 2 * (d - s["last"]) * rest, F.lit(0.0)))
            at = F.when(over, s["i"] - 1 + 2 * rest / (s["last"] + root)).otherwise(s["at"])
            return F.struct((s["sum"] + gain).alias("sum"), d.alias("last"), at.alias("at"), (s["i"] + 1).alias("i"))

        u = x["low"] + x["step"] * F.aggregate(x["d"], start, walk)["at"]
        return 1 / (1 + F.exp(-u))

    given = F.struct(a.alias("a"), b.alias("b"), mode.alias("mode"), low.alias("low"), step.alias("step"))
    inner = F.element_at(F.transform(F.array(given), found), 1)
    return F.when(a <= 0, F.lit(0.0)).when(b <= 0, F.lit(1.0)).otherwise(inner)


def moments(level: DataFrame) -> tuple[float, float]:
    """Mean rate and prior strength of a level, from its (n, bad) rows with n > 0; one row comes to the driver."""
    rated = level.where("n > 0").select("n", (F.col("bad") / F.col("n")).alias("p"))
    row = rated.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("p") * F.col("n")).alias("bad"),
        F.sum(1 / F.col("n")).alias("inverse"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("square"),
    ).first()
    if not row["k"]:
        return 0.0, 1.0
    k, n = row["k"], row["n"]
    mean = row["bad"] / n
    spread = max(0.0, row["square"] - n * mean * mean) * k / (n * max(1, k - 1))
    binomial = mean * (1 - mean)
    extra = spread - binomial * row["inverse"] / k
    strength = (binomial - spread) / extra if extra > 1e-12 else 1000.0
    return mean, min(1000.0, max(1.0, strength))


def host_reputation(located: DataFrame, outcomes: DataFrame, tail: float = 0.05) -> tuple[DataFrame, float]:
    """host, n and bad labelled pages, posterior mean and lower bound, one row for each host of ``located``; and the
    rate of bad pages among all.

    ``outcomes``: page_id, bad (0 or 1). A host with any share of the pages costs one row per task: counts are summed
    before the shuffle.
    """
    outcome = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = materialize(
        located.select("page_id", "host")
        .join(outcome, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .select("host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad"),
        "hosts",
    )
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(total(hosts, "domain", "suffix"), "domains")
    suffixes = materialize(total(domains, "suffix"), "suffixes")
    mean, m_suffix = moments(suffixes)
    (_, m_domain), (_, m_host) = moments(domains), moments(hosts)
    rate = lambda m, prior: (F.col("bad") + m * prior) / (F.col("n") + m)
    suffixes = suffixes.select("suffix", rate(m_suffix, F.lit(mean)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", rate(m_domain, F.col("suffix_rate")).alias("domain_rate"))
    a = F.col("bad") + m_host * F.col("domain_rate")
    b = F.col("n") - F.col("bad") + m_host * (1 - F.col("domain_rate"))
    rated = hosts.join(domains, "domain").select("host", "n", "bad", a.alias("a"), b.alias("b"))
    bound = beta_quantile(F.col("a"), F.col("b"), tail)
    return rated.select("host", "n", "bad", F.expr("a / (a + b)").alias("rate"), bound.alias("lower")), mean


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, tail: float = 0.05, lift: float = 1.0
) -> DataFrame:
    """page_id, host, path, rule, verdict; then the host's posterior mean and lower bound."""
    located = with_host(pages)
    rated, mean = host_reputation(located, outcomes, tail)
    reputation = materialize(rated.select("host", "rate", "lower"), "reputation")
    host, path = F.col("host"), F.col("path")
    method = F.when(F.col("lower") > lift * mean, "block").otherwise("allow")
    return located.join(reputation, "host", "left").select(
        "page_id", "host", "path",
        longest_rule(rules, host, path, lambda r: r.pattern).alias("rule"),
        F.coalesce(longest_rule(rules, host, path, lambda r: r.action), method).alias("verdict"),
        F.col("rate").alias("host_rate"), F.col("lower").alias("host_lower"),
    )


def labelled_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes of pages: a page is labelled by the row of ``labels`` with its id; bad is low quality or toxic."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))
