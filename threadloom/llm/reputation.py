"""URL filter: fixed rules first, else the reputation of the host by empirical Bayes.

Labelled pages are counted as bad or good per host. The bad rate of a host is
shrunk towards that of its registered domain, this towards its suffix, and this
towards all pages: each level's posterior mean is the mean of the beta prior
below it. The strength of a prior, in pages, comes from how much the rates of a
level differ more than chance (beta-binomial moments). A host is blocked if the
lower bound of its posterior bad rate is above ``BLOCK_ABOVE``: few labels never
block, since the bound of a host without labels stays near the prior.

Cases: a null url or one without ``://`` has empty host and path, fits no rule, and
is judged by the prior of all pages; hosts without labels get their domain's
prior; without any label nothing is blocked; null outcomes are left out; repeated
rows are judged alike and, if labelled, count as often as they occur; an empty
table gives an empty result; other columns pass through, except those named
like an output column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

#: (host, path, verdict). A rule fits its host, all subdomains, and paths that start with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Under two-letter country codes names are registered below these labels, as in co.uk or com.mx.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gub", "mil", "ne", "net", "or", "org")
BLOCK_ABOVE = 0.5
#: Standard deviations between the posterior mean and its bound.
BOUND = 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: Prior of the bad rate of all pages: one page, half of it bad.
FIRST_BAD, FIRST_PAGES = 0.5, 1.0
SALTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path."""
    at = F.instr(F.coalesce(F.col(url), F.lit("")), "://")
    rows = df.withColumn("_rest", F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit("")))
    rows = rows.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    behind = F.substring(F.col("_rest"), F.length("_host") + 1, F.length("_rest"))
    rows = rows.withColumns({"host": F.translate("_host", _UPPER, _LOWER), "path": F.regexp_extract(behind, "^[^?#]*", 0)})
    return rows.drop("_rest", "_host")


def rule_of(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, like ``net/``, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def levels(second_labels: Sequence[str] = SECOND_LABELS, suffixes: Sequence[str] = ()) -> dict[str, Column]:
    """Host without port, registered domain and suffix of a row with ``host``; ``suffixes`` are further ones of two labels.

    An IPv4 address is its own domain and suffix.
    """
    bare = F.regexp_replace("host", ":[0-9]*$", "")
    labels = F.split(bare, "\\.")
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    country = two.rlike(f"^({'|'.join(second_labels)})\\.[a-z]{{2}}$") if second_labels else F.lit(False)
    size = F.when(country | two.isin(*suffixes), 2).otherwise(1)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
    address = bare.rlike("^[0-9]+(\\.[0-9]+){3}$")
    own = lambda c: F.when(address, bare).otherwise(c)
    return {"_name": bare, "_domain": own(last(size + 1)), "_suffix": own(last(size))}


def _strength(units: DataFrame, mean: float) -> float:
    """Pages that the prior of a level is worth, from the spread of its units' rates."""
    row = units.agg(
        (F.sum("bad") / F.sum("pages")).alias("p"),
        F.sum("pages").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("pages") * F.col("pages")).alias("nn"),
        F.sum(F.col("pages") * F.pow(F.col("bad") / F.col("pages") - mean, 2)).alias("s"),
    ).first()
    if row["k"] < 2:
        return MOST_STRENGTH
    chance = row["p"] * (1 - row["p"])
    between = (row["s"] - (row["k"] - 1) * chance) / (row["n"] - row["nn"] / row["n"])
    return min(max((chance - between) / between, LEAST_STRENGTH), MOST_STRENGTH) if between > 0 else MOST_STRENGTH


def reputations(labelled: DataFrame) -> DataFrame:
    """Posterior bad rate of every labelled host, domain and suffix: (level, name, bad_mean, bad_low).

    The row of level "all" is the prior of suffixes without labels. ``labelled`` has _name, _domain, _suffix and bad (0 or 1). Only sums over a
    level come to the driver.
    """
    hosts = labelled.where("bad is not null").groupBy("_name", "_domain", "_suffix").agg(F.sum("bad").alias("bad"), F.count("*").alias("pages"))
    hosts = cut_lineage(hosts)
    add_up = lambda df, *keys: df.groupBy(*keys).agg(F.sum("bad").alias("bad"), F.sum("pages").alias("pages"))
    domains = add_up(hosts, "_domain", "_suffix")
    suffixes = add_up(hosts, "_suffix")
    row = hosts.agg(F.sum("bad").alias("bad"), F.sum("pages").alias("pages")).first()
    overall = ((row["bad"] or 0) + FIRST_BAD) / ((row["pages"] or 0) + FIRST_PAGES)

    def shrink(units: DataFrame, strength: float, prior: Column) -> DataFrame:
        total = F.col("pages") + strength
        mean = (F.col("bad") + strength * prior) / total
        units = units.withColumn("mean", mean)
        return units.withColumn("low", F.col("mean") - BOUND * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1)))

    strengths = [_strength(units, overall) for units in (suffixes, domains, hosts)]
    suffixes = shrink(suffixes, strengths[0], F.lit(overall))
    domains = shrink(domains.join(suffixes.select("_suffix", F.col("mean").alias("up")), "_suffix"), strengths[1], F.col("up"))
    hosts = shrink(hosts.join(domains.select("_domain", "_suffix", F.col("mean").alias("up")), ["_domain", "_suffix"]), strengths[2], F.col("up"))
    pick = lambda df, level, name: df.select(F.lit(level).alias("level"), F.col(name).alias("name"), F.col("mean").alias("bad_mean"), F.col("low").alias("bad_low"))
    low = overall - BOUND * (overall * (1 - overall) / (strengths[0] + 1)) ** 0.5
    everything = hosts.sparkSession.createDataFrame([("all", "", overall, low)], "level string, name string, bad_mean double, bad_low double")
    named = pick(hosts, "host", "_name").unionByName(pick(domains, "domain", "_domain")).unionByName(pick(suffixes, "suffix", "_suffix"))
    return cut_lineage(named.unionByName(everything))


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    second_labels: Sequence[str] = SECOND_LABELS,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """Add host, path, rule, verdict, bad_mean and bad_low.

    ``labelled`` has the url column and bad (0 or 1) of judged pages. The table of
    reputations may be large, and a host may hold much of all pages: hosts are
    reduced to one row before the join, and that row is dealt to several tasks.
    """
    added = ("host", "path", "rule", "verdict", "bad_mean", "bad_low")
    pages = with_host(pages.select(*[c for c in pages.columns if c not in added]), url)
    parts_of = levels(second_labels, suffixes)
    known = reputations(with_host(labelled.select(F.col(url).alias("url"), "bad")).withColumns(parts_of))
    everything = known.where("level = 'all'").select("bad_mean", "bad_low").first()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    parts = F.pmod(F.xxhash64(url, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    rows = pages.withColumns(parts_of).withColumn("_salt", parts)
    for level, name in (("host", "_name"), ("domain", "_domain"), ("suffix", "_suffix")):
        one = known.where(F.col("level") == level).select(F.col("name").alias(name), F.col("bad_mean").alias(f"_{level}_mean"), F.col("bad_low").alias(f"_{level}_low"), salts)
        rows = rows.join(one, [name, "_salt"], "left")
    first = lambda what: F.coalesce(*[F.col(f"_{level}_{what}") for level in ("host", "domain", "suffix")], F.lit(everything[f"bad_{what}"]))
    rule, verdict = rule_of(rules)
    method = F.when(first("low") > BLOCK_ABOVE, "block").otherwise("allow")
    kept = [c for c in pages.columns if c not in ("host", "path")]
    return rows.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), first("mean").alias("bad_mean"), first("low").alias("bad_low"))
