"""URL filtering by link-graph propagation.  DataFrame functions only.

Personalised PageRank spreads trust from hosts with allow rules along host links; distrust spreads from hosts with
block rules against them.  A host whose distrust outweighs its trust is blocked; a rule on the url always decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import written

#: (verdict, domain, path): fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING, ROUNDS = 0.85, 10
#: A host is blocked if its distrust is above MARGIN times its trust and above FLOOR times its share of all pages.
MARGIN, FLOOR = 2.0, 0.1
#: Weight of the links between a host and its parent domain, a page of the host.
KIN = 0.5
#: Labels under which registries of two-letter domains sell names (``co.uk``), so that these are no one's parent.
REGISTRY = ("ac", "co", "com", "ed", "edu", "go", "gob", "gov", "gouv", "govt", "gv", "id", "info", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), else null: its host and all subdomains, and its path as prefix."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in reversed(longest):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Weighted links between hosts: ``src, dst, weight``.

    Absolute and protocol-relative links of pages count once a page.  A page with a relative link links to its own host.
    A host and its parent domain (``blog.a.org`` and ``a.org``, up to the registered name: two labels, three under a
    REGISTRY label of a two-letter domain) are linked both ways with KIN times the host's pages, so that hosts of one domain
    share reputation where pages hold relative links only.
    """
    refs = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""), 1)
    own = host_of(F.col(url))
    absolute = lambda x: x.rlike("(?i)^(?:https?:)?//")
    target = lambda x: F.when(absolute(x), host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))).when(~x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^#"), own).otherwise("")
    links = pages.select(own.alias("src"), F.explode(F.array_distinct(F.transform(refs, target))).alias("dst")).where("src != '' and dst != ''")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(own.alias("src")).where("src != ''").groupBy("src").agg((F.count("*") * KIN).alias("weight"))
    labels = F.split("src", r"\.")
    level = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    suffix = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    registered = F.when((F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*REGISTRY), 3).otherwise(2)
    kin = hosts.where(F.size(labels) > 2).select(F.explode(F.transform(F.filter(level, lambda i: i <= F.size(labels) - registered), lambda i: F.struct(suffix(i).alias("a"), suffix(i + 1).alias("b")))).alias("x"), "weight")
    kin = kin.groupBy("x.a", "x.b").agg(F.sum("weight").alias("weight"))
    both = kin.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(kin.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: ``host, rank`` from ``edges(src, dst, weight)`` and ``seeds(host, seed)`` that sum to 1.

    Links to the host itself keep mass there.  Mass at hosts without outgoing links goes back to the seeds.  Each round is one join on the edge's source and one
    sum with partial aggregation, written to the shared folder; hosts out of reach have no row.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = written(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "links")
    rank = seeds.select("host", F.col("seed").alias("rank"))
    for _ in range(rounds):
        moved = rank.join(shares, rank.host == shares.src).select(
            F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank")
        )
        kept = rank.join(shares.select("src").distinct(), rank.host == F.col("src"), "left_anti").agg(F.sum("rank"))
        lost = damping * (kept.first()[0] or 0.0)  # one number
        back = seeds.select("host", (F.col("seed") * (1 - damping + lost)).alias("rank"))
        rank = written(moved.unionByName(back).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
    return rank


def _seeds(pages: DataFrame, verdict: str) -> DataFrame:
    """Hosts whose pages have a rule of this verdict, by their share of such pages."""
    own = pages.groupBy("host").agg(F.avg((F.coalesce(F.col("fit.verdict"), F.lit("")) == verdict).cast("double")).alias("share"))
    own = own.where("share > 0 and host != ''")
    total = own.agg(F.sum("share")).first()[0] or 1.0
    return own.select("host", (F.col("share") / total).alias("seed"))


def host_scores(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """Trust, distrust and verdict of every host: ``host, trust, distrust, verdict``."""
    fitted = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    fitted = fitted.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    fitted = written(fitted, "url-rules")
    edges = written(host_edges(pages, url, html), "host-edges")
    trust = personalised_rank(edges, _seeds(fitted, "allow"))
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(against, _seeds(fitted, "block"))
    hosts = fitted.groupBy("host").agg(F.count("*").alias("pages"))
    total = max(1, fitted.count())
    both = hosts.join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(
        distrust.withColumnRenamed("rank", "distrust"), "host", "left"
    )
    both = both.na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > MARGIN * F.col("trust")) & (F.col("distrust") * total > FLOOR * F.col("pages"))
    return both.select("host", "trust", "distrust", F.when((F.col("host") != "") & bad, "block").otherwise("allow").alias("verdict"))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """The verdict of every page url: ``page_id, host, path, rule, verdict, trust, distrust``.

    A null url or one without ``://`` has an empty host and path, no rule and is allowed.  A null html has no links.
    Repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    scores = written(host_scores(pages, url, html, rules), "host-scores").withColumnRenamed("verdict", "host_verdict")
    judged = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "host_verdict").alias("verdict"),
        "trust", "distrust",
    )
