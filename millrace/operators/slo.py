"""Service-level reports over rolling windows: daily rows that merge, exact quantiles, targets and a status.

A day's row holds counts and a quantile sketch of latencies, so windows of any length merge days instead of
reading events again, in batch and behind a stream alike. Beside the sketch stands the exact nearest-rank
rule: a sketch brackets each quantile, and only values inside the bracket are counted one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import written

#: Size of a sketch, and the rank error around a quantile that is surely more than its own (of about 1.33 / K ** 0.9).
K, ERROR = 2000, 0.005
GRADES = ("usable", "thin", "garbled", "empty")

# Targets in percent and milliseconds by window.
TARGETS = {7: {"search": 99.0, "fetch": 98.0}, 30: {"search": 98.0, "fetch": 97.0}}
SEARCH_P95_MS, LEAST_USABLE, MOST_THIN, MOST_TRUNCATED = 5000.0, 85.0, 10.0, 25.0

#: A report file's JSON, old and new layout in one; what a layout lacks is null.
_SECTION = "struct<total: bigint, count: bigint, successful: bigint, success: bigint, success_count: bigint, latencies_ms: variant, p50_latency_ms: double, p95_latency_ms: double, fallback_count: bigint, error_types: map<string,bigint>, providers: map<string,bigint>, provider_distribution: map<string,bigint>>"
_QUALITY = "struct<fetches: bigint, usable: bigint, thin: bigint, garbled: bigint, empty: bigint, truncated_by_output_limit: bigint>"
REPORT = f"struct<timestamp: string, run_time: string, search: {_SECTION}, search_stats: {_SECTION}, fetch: {_SECTION}, fetch_stats: {_SECTION}, fallback: struct<count: bigint, success_count: bigint>, error_types: map<string,bigint>, provider_distribution: map<string,bigint>, content_quality: {_QUALITY}>"


@dataclass(frozen=True)
class Targets:
    """What a window is held to; a kind without a target for a window is not."""

    success: dict[int, dict[str, float]] = field(default_factory=lambda: TARGETS)
    search_p95: float = SEARCH_P95_MS
    usable: float = LEAST_USABLE
    thin: float = MOST_THIN
    truncated: float = MOST_TRUNCATED


def report_time(raw: Column) -> Column:
    """A report's time: seconds since 1970 as a number or a text, or ISO 8601; null if missing, an error if it is anything else."""
    text = F.trim(raw)
    number = F.timestamp_micros((text.cast("double") * 1_000_000).cast("long"))
    parsed = F.try_to_timestamp(text)
    bad = F.raise_error(F.concat(F.lit("cannot read the time of a report: "), text)).cast("timestamp")
    return F.when(raw.isNull() | (text == ""), F.lit(None)).when(text.rlike(r"^-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"), number).otherwise(F.coalesce(parsed, bad))


def samples(section: Column) -> Column:
    """A section's latencies: its list or number, else its median and 95th percentile as samples of their own."""
    raw = section["latencies_ms"]
    listed = F.coalesce(F.try_variant_get(raw, "$", "array<double>"), F.array(F.try_variant_get(raw, "$", "double")))
    listed = F.filter(listed, lambda v: v.isNotNull())
    spare = F.filter(F.array(section["p50_latency_ms"], section["p95_latency_ms"]), lambda v: v.isNotNull())
    return F.when(F.size(listed) > 0, listed).otherwise(spare)


def read_reports(texts: DataFrame, column: str = "value") -> DataFrame:
    """Report JSON texts as rows: at, and per kind total, successful and samples; fallbacks, content quality. Text that is no JSON is left out."""
    r = texts.where(F.try_parse_json(column).isNotNull()).select(F.from_json(column, REPORT).alias("r")).where("r is not null").select("r.*")
    zero = F.lit(0).cast("long")

    def kind(name: str) -> list[Column]:
        s = F.coalesce(f"{name}_stats", name)
        return [
            F.coalesce(s["total"], s["count"], zero).alias(f"{name}_total"), F.coalesce(s["successful"], s["success"], s["success_count"], zero).alias(f"{name}_successful"),
            samples(s).alias(f"{name}_samples"), F.coalesce(s["fallback_count"], zero).alias(f"{name}_fallbacks"), s["error_types"].alias(f"{name}_errors"),
            F.coalesce(s["providers"], s["provider_distribution"]).alias(f"{name}_providers"),
        ]

    fallbacks = F.coalesce("fallback.count", "fallback.success_count", zero)
    quality = [F.coalesce(f"content_quality.{g}", zero).alias(g) for g in ("fetches", *GRADES)] + [F.coalesce("content_quality.truncated_by_output_limit", zero).alias("truncated")]
    flat = r.select(report_time(F.coalesce("timestamp", "run_time")).alias("at"), *kind("search"), *kind("fetch"), fallbacks.alias("other_fallbacks"), F.col("error_types").alias("other_errors"), F.col("provider_distribution").alias("other_providers"), F.col("content_quality").isNotNull().alias("has_quality"), *quality)
    return flat.withColumn("fallbacks", F.col("search_fallbacks") + F.col("other_fallbacks")).drop("search_fallbacks", "fetch_fallbacks", "other_fallbacks")


def tallies(reports: DataFrame, what: str) -> DataFrame:
    """Sums of the reports' maps of ``errors`` or ``providers`` by key."""
    maps = reports.select(F.inline(F.flatten(F.transform(F.array(*[F.coalesce(F.col(f"{k}_{what}"), F.create_map().cast("map<string,bigint>")) for k in ("search", "fetch", "other")]), F.map_entries))))
    return maps.groupBy("key").agg(F.sum("value").alias("n"))


def daily(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events (at, kind, ok, latency, grade, truncated) as rows of a day and kind that merge; with ``late``, of a stream with that watermark.

    Grades count where there is one; latencies that are null are in no sketch.
    """
    rows = events.withWatermark("at", late) if late else events
    grades = [F.count_if(F.col("grade") == g).alias(g) for g in GRADES]
    per = rows.groupBy(F.window("at", "1 day"), "kind").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("successful"), *grades, F.count("grade").alias("graded"), F.count_if(F.col("truncated") & F.col("grade").isNotNull()).alias("truncated"),
        F.kll_sketch_agg_double("latency", F.lit(K)).alias("sketch"),
    )
    return per.select(F.col("window.start").alias("day"), "kind", "total", "successful", *GRADES, "graded", "truncated", "sketch")


def merged(days: DataFrame, as_of: Column, lengths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per window length and kind the sums of its whole days up to ``as_of``, with p50 and p95 from the merged sketches."""
    rows = days.select("*", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("days")).where((F.col("day") <= as_of) & (F.col("day") > as_of - F.make_dt_interval("days")))
    sums = [F.sum(c).alias(c) for c in ("total", "successful", *GRADES, "graded", "truncated")]
    out = rows.groupBy("days", "kind").agg(*sums, F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"))
    p = lambda q: F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return out.select("*", p(0.5).alias("p50"), p(0.95).alias("p95")).drop("sketch")


def exact_quantiles(rows: DataFrame, group: list[str], value: str, ps: tuple[float, ...], error: float = ERROR, k: int = K) -> DataFrame:
    """group, p, value: the nearest-rank quantiles, exact. Nulls are left out; a group without values has no row.

    A sketch gives each quantile a bracket that its rank lies in; values below are only counted, and those
    inside are summed by distinct value and run through in order: about ``2 * error`` of all. Where counts
    show that a bracket missed its rank, it is opened and that quantile is done again. ``rows`` is read three times.
    """
    held = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"))
    spread = held.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("s"))
    edge = lambda q, beyond: F.lit(beyond) if not 0 < q < 1 else F.kll_sketch_get_quantile_double("s", F.lit(q))
    each = [F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("n") * p)).alias("rank"), edge(p - error, float("-inf")).alias("lo"), edge(p + error, float("inf")).alias("hi")) for p in ps]
    brackets = spread.select(*group, F.inline(F.array(*each)))

    def search(brackets: DataFrame) -> tuple[DataFrame, DataFrame]:
        brackets = written(brackets, "brackets")  # sketches are random: the bracket is drawn once
        near = held.join(brackets, group).where("v <= hi")
        counts = near.groupBy(*group, "p", "rank", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        counts = written(counts, "counts")
        upto = F.sum("n").over(Window.partitionBy(*group, "p").orderBy(F.col("v").asc_nulls_first()))
        found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank"))).groupBy(*group, "p").agg(F.min_by("v", "upto").alias("value"))
        return found.where("value is not null"), brackets.join(found.where("value is not null"), [*group, "p"], "left_anti")

    found, missed = search(brackets)
    missed = written(missed, "missed")
    if missed.isEmpty():
        return found
    return found.unionByName(search(missed.withColumn("lo", F.lit(float("-inf"))).withColumn("hi", F.lit(float("inf"))))[0])


def report(windows: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """One row per window length from rows of days, kind, total, successful, p50, p95, grades and truncated: rates, violations, notes and status.

    A rate without cases is null and violates nothing. Success below its target makes the status violating; a 7-day search
    p95 above its target makes it a warning, even then; little usable content makes it violating, much thin
    content a warning if nothing else was wrong. Truncation is only noted. No cases at all are no data.
    """
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    sums = [of(k, c).alias(f"{k}_{c}") for k in ("search", "fetch") for c in ("total", "successful", "p50", "p95")]
    wide = windows.groupBy("days").agg(*sums, *[F.sum(c).alias(c) for c in (*GRADES, "graded", "truncated")])
    wide = wide.fillna(0, [f"{k}_{c}" for k in ("search", "fetch") for c in ("total", "successful")])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100)
    wide = wide.withColumns({f"{k}_rate": rate(f"{k}_successful", f"{k}_total") for k in ("search", "fetch")} | {f"{g}_rate": rate(g, "graded") for g in (*GRADES, "truncated")})
    wanted = lambda kind: F.coalesce(*[F.when(F.col("days") == d, F.lit(t[kind])) for d, t in targets.success.items() if kind in t], F.lit(None).cast("double"))
    low = {k: F.coalesce(F.col(f"{k}_rate") < wanted(k), F.lit(False)) for k in ("search", "fetch")}
    slow = (F.col("days") == 7) & (F.col("search_total") > 0) & F.coalesce(F.col("search_p95") > targets.search_p95, F.lit(False))
    poor, thin = F.coalesce(F.col("usable_rate") < targets.usable, F.lit(False)), F.coalesce(F.col("thin_rate") > targets.thin, F.lit(False))
    nothing = (F.col("search_total") == 0) & (F.col("fetch_total") == 0) & (F.coalesce("graded", F.lit(0)) == 0)
    said = [F.when(low["search"], "search success"), F.when(low["fetch"], "fetch success"), F.when(slow, "search p95"), F.when(poor, "usable content"), F.when(thin, "thin content"), F.when(nothing, "no observations")]
    early = F.when(slow, "warning").when(low["search"] | low["fetch"], "violating").otherwise("healthy")
    status = F.when(poor, "violating").when(thin & (early == "healthy"), "warning").when(nothing & (early == "healthy"), "no_data").otherwise(early)
    whole = wide.select("*", F.filter(F.array(*said), lambda x: x.isNotNull()).alias("violations"), F.when(F.col("truncated_rate") > targets.truncated, "truncation").alias("notes"), status.alias("status"))
    rates = [F.round(c, 2).alias(c) for c in ("search_rate", "fetch_rate", *[f"{g}_rate" for g in (*GRADES, "truncated")])]
    p = [F.round(F.coalesce(c, F.lit(0.0)), 1).alias(c) for c in ("search_p50", "search_p95", "fetch_p50", "fetch_p95")]
    return whole.select("days", "status", "violations", "notes", "search_total", "search_successful", "fetch_total", "fetch_successful", *rates, *p)
