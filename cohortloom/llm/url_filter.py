"""URL filters: rules first, then trust and distrust propagated over host links.

Trust is a personalised PageRank from trusted hosts along links; distrust the same from blocked
hosts against links: who links to the bad is suspect. Both run in one loop over a table of
(kind, host, score); each round is a join and a sum, written to the shared folder. A host is
blocked if its distrust exceeds its trust by ``ratio``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Labels under which two-letter country domains register names.
REGISTRIES = ("ac", "co", "com", "edu", "gov", "gob", "mil", "ne", "net", "nom", "or", "org")
LINK = r"""(?i)(?:href|src)\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""


def with_host_path(df: DataFrame, url_col: str) -> DataFrame:
    """Adds _host and _path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return df.withColumns({"_host": F.translate(raw, UPPER, LOWER), "_path": path})


def _suffixes(host):
    """The host and each domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_suffix(host):
    """Whether a domain is one under which anybody registers names: a single label, or one of
    ``REGISTRIES`` below a country's two letters."""
    labels = F.split(host, r"\.")
    country = (F.size(labels) == 2) & (F.length(F.element_at(labels, -1)) == 2) & labels[0].isin(*REGISTRIES)
    return (F.size(labels) == 1) | country


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of a host and of the domains above it, longest first."""
    by_host = rules.groupBy(F.col("rule_host").alias("domain")).agg(
        F.collect_list(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.col("rule_path").alias("path"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("found")
    )
    return (
        hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("domain"))
        .join(by_host, "domain")
        .groupBy("host")
        .agg(F.reverse(F.array_sort(F.flatten(F.collect_list("found")))).alias("rules"))
    )


def link_edges(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, and one link each way between a
    host and the domain above it, up to the last label. Links to and from a public suffix weigh
    nothing (n = 0): what shares only ``com`` or ``co.uk`` is not related."""
    found = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))
    links = pages.filter(F.col(host_col) != "").select(F.col(host_col).alias("src"), found.alias("dst"))
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER)).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.filter(F.col(host_col) != "").select(F.col(host_col).alias("src")).distinct().unionAll(links.select("dst"))
    chain = _suffixes(F.col("src"))
    above = (
        hosts.distinct()
        .select(F.explode(F.zip_with(chain, F.slice(chain, 2, F.size(chain)), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("e"))
        .select("e.src", "e.dst")
        .filter("dst IS NOT NULL")
        .distinct()
    )
    family = above.unionAll(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.when(is_suffix(F.col("src")) | is_suffix(F.col("dst")), 0).otherwise(1).cast("long"))
    return links.unionAll(family).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.5, tolerance: float = 1e-3) -> DataFrame:
    """(host, trust, distrust) of hosts reached from ``seeds`` (host, kind: trust or distrust).
    Scores of a kind sum to 1 at most; the loop ends when they move by less than ``tolerance``
    in all, which a damping below 1 brings about after log(tolerance) / log(damping) rounds."""
    if not 0 <= damping < 1:
        raise ValueError("the scores converge for a damping from 0 to below 1 only")
    edges = edges.filter("n > 0")
    directed = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionAll(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = directed.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    directed = materialise(directed.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "links")
    seeds = seeds.distinct()
    totals = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    base = materialise(seeds.join(totals, "kind").select("kind", "host", (1 / F.col("n")).alias("seed")), "seeds")
    now = base.withColumnRenamed("seed", "score")
    while True:
        flow = (
            now.withColumnRenamed("host", "src")
            .join(directed, ["kind", "src"])
            .select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("gain"))
            .unionAll(base.select("kind", "host", (F.col("seed") * (1 - damping)).alias("gain")))
            .groupBy("kind", "host")
            .agg(F.sum("gain").alias("score"))
        )
        then = materialise(flow.join(now.withColumnRenamed("score", "before"), ["kind", "host"], "left"), "scores")
        moved = then.agg(F.sum(F.abs(F.col("score") - F.coalesce("before", F.lit(0.0))))).first()[0] or 0.0
        now = then.select("kind", "host", "score")
        if moved < tolerance:
            break
    return now.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"),
    )


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = 1.0,
    damping: float = 0.5,
    shares: int = 32,
) -> DataFrame:
    """Per row: ``id_col``, host, path, rule, verdict, trust and distrust.

    ``rules`` are (verdict, host, path) and fit the host and all below it where the url's path
    starts with the rule's; the longest decides, equal lengths by the rule's text. A page that
    no rule fits gets its host's verdict: block if distrust > ratio * trust, else allow. Seeds
    come from the rules: a host with a blocked page is a blocked seed, a host with allowed pages
    only a trusted one.

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed.
    Null html has no links. Repeated rows are judged each; other columns are not looked at. An
    empty table gives an empty result.

    What is known of a host is copied to ``shares`` groups of pages, so that the pages of a very
    common host are joined in as many tasks.
    """
    spark = pages.sparkSession
    plain = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    parsed = with_host_path(plain, "_url").select("_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_html").alias("html"))
    rule_table = spark.createDataFrame([(h, p, v) for v, h, p in rules], "rule_host string, rule_path string, verdict string")
    edges = materialise(link_edges(parsed, "host", "html"), "host-links")
    share = F.pmod(F.xxhash64("_id", "path"), F.lit(shares)).cast("int")
    urls = materialise(parsed.drop("html").withColumn("share", share), "urls")
    each = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    hosts = urls.filter("host <> ''").select("host").distinct()
    known = host_rules(hosts, rule_table)
    judged = urls.join(known.withColumn("share", each), ["host", "share"], "left").select(
        "_id", "host", "share", "path", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)).alias("r")
    )
    judged = materialise(judged.select("_id", "host", "share", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("by_rule")), "urls-judged")
    tally = judged.filter("by_rule IS NOT NULL").groupBy("host").agg(F.max((F.col("by_rule") == "block").cast("int")).alias("bad"))
    seeds = tally.select("host", F.when(F.col("bad") == 1, "distrust").otherwise("trust").alias("kind"))
    scores = propagate(edges, seeds, damping=damping)
    none = F.lit(0.0)
    return (
        judged.join(scores.withColumn("share", each), ["host", "share"], "left")
        .select(
            F.col("_id").alias(id_col),
            "host",
            "path",
            "rule",
            F.coalesce("by_rule", F.when(F.coalesce("distrust", none) > ratio * F.coalesce("trust", none), "block").otherwise("allow")).alias("verdict"),
            F.coalesce("trust", none).alias("trust"),
            F.coalesce("distrust", none).alias("distrust"),
        )
    )
