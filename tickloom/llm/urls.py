"""URL filter: rules first, and trust propagated over the host graph for the rest.

Trust is a personalised PageRank from hosts that a rule allows; distrust is the
same walk over reversed links from hosts that a rule blocks. Masses are integers,
so results do not depend on the order of sums, and all seeds share ``TOTAL``, so
that no sum overflows. The walk goes on until nothing is left to pass on that is
worth ``TOLERANCE`` of a seed's own mass. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, discard, materialise

#: Mass of all seeds; a seed has at most ``SEED_MASS``. 85 times the total fits a BIGINT.
TOTAL, SEED_MASS = 100_000_000_000_000_000, 1_000_000_000_000
DAMPING_PERCENT = 85
#: What a host has got but not passed on yet is dropped below this part of a seed's mass.
TOLERANCE = 10_000
#: Rules up to this number are looked up in one map; more are joined.
MAX_RULES = 10_000
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _joined_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """As ``apply_rules``, by an equi-join of each page's host suffixes and path beginnings with the rules.

    A page has as many candidates as its host has labels times the different
    lengths of rule paths, whatever the number of rules.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(h, p, v) for v, h, p in rules], "_host string, _path string, _verdict string").groupBy("_host", "_path").agg(F.min("_verdict").alias("_verdict"))
    sizes = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p in rules})])
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = pages.select("host", "path").distinct()
    near = keys.withColumn("_host", F.explode(suffixes)).withColumn("_n", F.explode(F.filter(sizes, lambda n: n <= F.length("path")))).withColumn("_path", F.expr("substring(path, 1, _n)"))
    best = near.join(table, ["_host", "_path"]).groupBy("host", "path").agg(F.min(F.struct((-F.length(F.concat("_host", "_path"))).alias("n"), F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_fit"))
    return pages.join(best, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in pages.columns], F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("rule_verdict"))


def apply_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits, else null.

    A rule fits its host and all subdomains where the path starts with the
    rule's. Up to ``MAX_RULES`` rules are looked up by each suffix of the host in
    one map, without a join; more are joined. Equal lengths: the smaller rule.
    """
    if len(rules) > MAX_RULES:
        return _joined_rules(pages, rules)
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    entries = []
    for host, paths in sorted(by_host.items()):
        entries += [F.lit(host), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("verdict")) for p, v in paths])]
    rule_map = F.create_map(*entries)
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = F.flatten(
        F.transform(
            F.filter(suffixes, lambda h: F.map_contains_key(rule_map, h)),
            lambda h: F.transform(
                F.filter(F.element_at(rule_map, h), lambda r: F.startswith(F.col("path"), r["path"])),
                lambda r: F.struct((-F.length(F.concat(h, r["path"]))).alias("n"), F.concat(h, r["path"]).alias("rule"), r["verdict"].alias("verdict")),
            ),
        )
    )
    return pages.withColumn("_fit", F.array_min(fits)).withColumns({"rule": F.col("_fit.rule"), "rule_verdict": F.col("_fit.verdict")}).drop("_fit")


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` host links: of the pages' markup, and between a page host and its parent host if both have pages.

    Links are made distinct within a page and again before the shuffle, so a host
    with a third of all pages costs its distinct links once per task.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    child = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst"))
    family = child.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst")
    family = family.union(family.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.union(family).where("src <> dst and src <> '' and dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host, trust, distrust`` of the walks from ``seeds(host, trusted, blocked)``.

    Both walks run in one loop, as kinds of one state. In a step, hosts pass on
    what they got in the step before: edges and state are both read from files,
    so that a hub's links can be split over tasks, and sums are pre-aggregated.
    What a host has got in all is summed once at the end. A seed's mass falls by
    the damping with each step, so there are at most 57 steps at the tolerance of
    a ten-thousandth, and hosts that far from a seed are reached.
    """
    both = materialise(edges.select(F.lit(0).alias("kind"), "src", "dst").union(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))), "moves")
    degree = materialise(both.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    moves = materialise(both.join(degree, ["kind", "src"]), "moves")
    start = materialise(seeds.where("trusted").select(F.lit(0).alias("kind"), "host").union(seeds.where("blocked").select(F.lit(1).alias("kind"), "host")), "seeds")
    base = min(SEED_MASS, TOTAL // max(1, start.count())) * (100 - DAMPING_PERCENT) // 100
    got = [materialise(start.withColumn("mass", F.lit(base).cast("long")), "state")]
    least = base // TOLERANCE
    for done in (both, degree, start):
        discard(done)
    while not got[-1].isEmpty():
        sent = moves.join(got[-1].where(f"mass >= {least}").withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.expr(f"(mass * {DAMPING_PERCENT}) div (100 * degree)").alias("mass"))
        got.append(materialise(sent.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0"), "state"))
    spark = edges.sparkSession
    every = spark.read.schema(got[0].schema).parquet(*sorted({f.rsplit("/", 1)[0] for df in got for f in df.inputFiles()}))
    out = materialise(every.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("mass"))), F.lit(0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("mass"))), F.lit(0)).alias("distrust"),
    ), "mass")
    for done in (moves, *got):
        discard(done)
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_percent: int = 100) -> DataFrame:
    """Judge every page: ``page_id, host, path, rule, verdict, trust, distrust``.

    The longest fitting rule decides; else a host is blocked if its distrust is
    above ``block_percent`` percent of its trust, and allowed otherwise, so an
    unknown host is allowed. A host
    is a seed of trust (distrust) if a rule allows (blocks) any of its pages. A
    null url, or one without ``://``, has an empty host and path and is allowed;
    null markup has no links; markup of any length is searched whole; repeated
    rows are judged each; of equally long rules the smaller wins; other columns
    are ignored; an empty table gives an empty result.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    judged = apply_rules(parsed, rules)
    hosts = materialise(judged.where("host <> ''").groupBy("host").agg(F.max(F.coalesce(F.col("rule_verdict") == "allow", F.lit(False))).alias("trusted"), F.max(F.coalesce(F.col("rule_verdict") == "block", F.lit(False))).alias("blocked")), "hosts")
    mass = propagate(host_edges(parsed, hosts), hosts)
    out = judged.drop("html").join(mass, "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0)).cast("long") for c in ("trust", "distrust"))
    verdict = F.coalesce("rule_verdict", F.when(100 * distrust > block_percent * trust, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
