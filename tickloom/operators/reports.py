"""What the reports show: composites over manifests, stores, bars and probes, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import market_open
from ..functions.text import gib
from ..sources.logs import harvest_costs, throughput
from .coverage import KINDS, counts, counts_by_year, evidence, hole_verdicts, holes, last_probe, recommended_start, series
from .manifest import coverage_summary, gap_list, hour_instant, spread_by_session, totals

Section = tuple[str, DataFrame | list[str]]


def boundary_audit(hours: DataFrame) -> DataFrame:
    """By pair: closed hours that were asked for, closed hours with ticks, and open hours without."""
    open_ = market_open(hour_instant())
    return hours.groupBy("pair").agg(
        F.count_if(~open_ & (F.col("status") != "closed")).alias("closed_but_answered"), F.count_if(~open_ & (F.col("decoded_ticks") > 0)).alias("closed_but_traded"), F.count_if(open_ & (F.col("status") == "empty")).alias("open_but_empty")
    )


def completeness(hours: DataFrame) -> DataFrame:
    """By pair: open hours expected, hours with ticks, their share, and gaps."""
    open_ = market_open(hour_instant())
    out = hours.groupBy("pair").agg(F.count_if(open_).alias("expected"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "gap").alias("gaps"), F.sum("written_ticks").alias("ticks"))
    return out.withColumn("share", F.when(F.col("expected") > 0, F.round(F.col("ok") / F.col("expected"), 6)))


def extremes(by_pair: DataFrame, holes: DataFrame) -> DataFrame:
    """One row: the pair with the least complete hours, and the longest hole."""
    worst = by_pair.agg(F.min_by("pair", F.struct("share", "pair")).alias("worst_pair"), F.min("share").alias("worst_share"))
    key = F.struct("trading_days", "start", "pair")
    longest = holes.agg(F.max(key).alias("h")).select(F.col("h.pair").alias("hole_pair"), F.col("h.start").alias("hole_start"), F.col("h.trading_days").alias("hole_days"))
    return worst.crossJoin(longest)


def quality_trend(checks: DataFrame) -> DataFrame:
    """By pair: the earliest and the latest spot check that passed, and the ratio of their spreads; no self-join."""
    ok = checks.where("ok")
    pick = F.struct("date", "ticks", "median_pips")
    ends = ok.groupBy("pair").agg(F.min_by(pick, "date").alias("a"), F.max_by(pick, "date").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return ends.select("pair", F.col("a.date").alias("first"), F.col("a.median_pips").alias("first_pips"), F.col("b.date").alias("last"), F.col("b.median_pips").alias("last_pips"), F.round(F.col("a.median_pips") / F.col("b.median_pips"), 6).alias("ratio"))


def survey_against_store(by_year: DataFrame, hours: DataFrame) -> DataFrame:
    """By pair: share of data among the survey's probes of the years that the store has, beside the store's own share."""
    years = hours.select("pair", F.year("date").alias("year")).distinct()
    kinds = [c for c in by_year.columns if c not in ("pair", "year")]
    total = sum((F.col(c) for c in kinds[1:]), F.col(kinds[0]))
    probed = by_year.join(years, ["pair", "year"]).groupBy("pair").agg((F.sum("data") / F.sum(total)).alias("probed_share"))
    return completeness(hours).join(probed, "pair").select("pair", F.round("probed_share", 6).alias("probed_share"), F.col("share").alias("stored_share"))


def bar_extent(bars: DataFrame) -> DataFrame:
    """Rows, first and last bar by timeframe and pair."""
    return bars.groupBy("timeframe", "pair").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def store_report(ticks: DataFrame, hours: DataFrame) -> DataFrame:
    """By pair: completeness, overall spread and the share of ticks in each session."""
    spread = spread_by_session(ticks)
    overall = spread.where("session = 'all'").select("pair", F.col("p50").alias("median_pips"), F.col("p99").alias("p99_pips"), F.col("ticks").alias("all_ticks"))
    by_session = spread.where("session <> 'all'").groupBy("pair").agg(F.max_by("session", F.struct("ticks", "session")).alias("busiest_session"), F.max("ticks").alias("busiest_ticks"))
    return completeness(hours).join(overall, "pair", "left").join(by_session, "pair", "left")


def build_throughput(chunks: DataFrame) -> DataFrame:
    """Builds, dates, rows and seconds by timeframe, of chunk records' ``bars`` arrays."""
    b = chunks.select(F.explode("bars").alias("b")).select("b.*")
    return b.groupBy("timeframe").agg(F.count(F.lit(1)).alias("builds"), F.sum("dates").alias("dates"), F.sum("rows").alias("rows"), F.round(F.sum("seconds"), 2).alias("seconds"))


def markdown(df: DataFrame, most: int = 120) -> str:
    """The first ``most`` rows as a table, and a line that says how many more there are; the frame must be ordered."""
    rows = df.limit(most + 1).collect()

    def cell(v: object) -> str:
        return "-" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\n{df.count() - most:,} more rows are not shown.")
    return "\n".join(lines)


def document(title: str, facts: dict[str, object], sections: list[Section]) -> str:
    """A report: its title, a line for each fact that is known, and each section's table or lines."""
    lines = [f"# {title}", "", *[f"* {name}: {value}" for name, value in facts.items() if value is not None], ""]
    for heading, body in sections:
        shown = ([f"* {line}" for line in body] or ["None."]) if isinstance(body, list) else [markdown(body)]
        lines += [f"## {heading}", "", *shown, ""]
    return "\n".join(lines).rstrip() + "\n"


def ingest_sections(hours: DataFrame, ticks: DataFrame, bars: DataFrame | None = None, stored: DataFrame | None = None, sessions: DataFrame | None = None, by_year: DataFrame | None = None) -> list[Section]:
    """What an ingestion report has: of manifest hours, stored ticks and bars, ``store.footprint``, session logs, and a survey's counts by year."""
    warned = hours.withColumn("empty_trading_hour", F.exists("issues", lambda i: i["reason"] == "EMPTY_TRADING_HOUR"))
    rolled = totals(warned)
    noted = hours.select(F.explode("issues").alias("i")).select("i.reason", "i.count")
    out: list[Section] = [
        ("Totals", coverage_summary(hours).orderBy("status")), ("Pairs", store_report(ticks, hours).orderBy("pair")), ("Years", rolled.where("pair is not null and year is not null").orderBy("pair", "year")),
        ("Gaps", gap_list(hours)), ("Boundaries", boundary_audit(hours).orderBy("pair")), ("Validation", reason_lines(noted)),
    ]
    if sessions is not None:
        out.append(("Throughput", throughput(sessions).orderBy("level")))
    if stored is not None:
        out.append(("Storage", stored.withColumn("size", gib(F.col("bytes"))).orderBy("pair")))
    if bars is not None:
        out.append(("Bars", bar_extent(bars).orderBy("timeframe", "pair")))
    if by_year is not None:
        out.append(("Survey and store", survey_against_store(by_year, hours).orderBy("pair")))
    return out


def survey_sections(calendar: DataFrame, probes: DataFrame, hour: int, checks: DataFrame | None = None, ledger: DataFrame | None = None, fraction: float = 0.95, window: int = 250, least: int = 5) -> list[Section]:
    """What a coverage report has: of the pairs' trading days, probes with ``line_no``, spot checks and the ledger."""
    last = last_probe(probes)
    days = series(calendar, last, hour)
    starts = recommended_start(days, fraction, window)
    found = hole_verdicts(holes(days, least, starts), evidence(last, hour)).select("pair", "start", "end", "trading_days", "verdict", "refined_days", "with_data")
    by_kind = counts(days)
    asked = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    share = by_kind.select("pair", F.when(asked > 0, F.round(F.col("data") / asked, 6)).alias("share"))
    out: list[Section] = [
        ("Completeness", by_kind.join(share, "pair").orderBy("pair")), ("Starts", starts.orderBy("pair")), ("Years", counts_by_year(days).orderBy("pair", "year")), ("Holes", found.orderBy("pair", "start")), ("Extremes", extremes(share, found)),
    ]
    if checks is not None:
        out.append(("Quality", quality_trend(checks).orderBy("pair")))
    if ledger is not None:
        out.append(("Cost", harvest_costs(ledger).orderBy("experiment_id")))
    return out


def reason_lines(issues: DataFrame) -> list[str]:
    """One line per reason with its hours and ticks, as logs show them."""
    rows = issues.groupBy("reason").agg(F.count(F.lit(1)).alias("hours"), F.sum("count").alias("ticks")).orderBy("reason").collect()
    return [f"{r.reason}: {r.ticks:,} in {r.hours:,} hours" for r in rows]


def result_document(trades: DataFrame, curve: DataFrame, summary: DataFrame) -> DataFrame:
    """The parts of a result as JSON lines: ``part, json``; each part stays distributed."""
    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))

    return part(summary, "summary").unionByName(part(trades, "trade")).unionByName(part(curve, "equity"))


def result_hash(df: DataFrame) -> Column:
    """An aggregate: SHA-256 over the sorted JSON of rows, doubles rounded to six places; for results of report size."""
    plain = F.struct(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])
    return F.sha2(F.array_join(F.sort_array(F.collect_list(F.to_json(plain))), "\n"), 256)
