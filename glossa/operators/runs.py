"""Analytics of repeated runs: batches, blocks, descriptive statistics, stability, verdicts, schedules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def describe(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """count, mean, median, sd (0 below two values), min, max and nearest-rank p95 of a value by some columns."""
    v = F.col(value).cast("double")
    return long.groupBy(*by).agg(
        F.count(v).alias("count"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.median(v), F.lit(0.0)).alias("median"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.coalesce(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY CAST({value} AS DOUBLE))"), F.lit(0.0)).alias("p95"),
    )


def metric_stack(rows: DataFrame, metrics: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Long form (metric, value) of several columns; unreadable values count as 0."""
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias("value")) for name, c in metrics.items()])
    return rows.select(*(by or []), F.inline(pairs))


def linear_quantile(value: str, q: float) -> Column:
    return F.coalesce(F.percentile(F.col(value).cast("double"), q), F.lit(0.0))


def batch_rows(manifests: DataFrame) -> DataFrame:
    """Manifests (run_id, time_block, runtime_seconds, return_code, batch, per_paper) with completion, success and failure class."""
    n, ok = F.size("per_paper"), F.size(F.filter("per_paper", lambda p: p["status"] == "ok"))
    bad = F.size(F.filter("per_paper", lambda p: p["status"].isNotNull() & ~p["status"].isin("", "ok", "timeout", "no_full_text")))
    number = lambda c: F.coalesce(F.col(f"batch.{c}").cast("long"), F.lit(0))
    has = F.coalesce(n, F.lit(0)) > 0
    b = manifests.withColumns({
        "completed_papers": F.when(has, ok).otherwise(number("completed_papers")).cast("long"), "total_papers": F.when(has, n).otherwise(number("total_papers")).cast("long"),
        "failed_papers": F.when(has, bad).otherwise(number("failed_papers")).cast("long"),
        **{c: number(c) for c in ("quota_limited_papers", "quota_limited_rows", "timeout_count", "gemini_api_calls", "gemini_total_tokens", "gemini_error_count", "model_unavailable_count", "permission_denied_count", "output_rows")},
    }).drop("batch", "per_paper")
    return classified(b)


def classified(batches: DataFrame) -> DataFrame:
    """Adds completion_rate, successful and failure_class to batches with counters."""
    b = batches.withColumn("completion_rate", F.col("completed_papers") / F.greatest(F.col("total_papers"), F.lit(1)))
    b = b.withColumn("successful", (F.col("total_papers") > 0) & (F.col("completed_papers") == F.col("total_papers")))
    return b.withColumn("failure_class", failure_class())


def failure_class() -> Column:
    """One of ten labels, the first that applies."""
    quota = (F.col("quota_limited_rows") > 0) | (F.col("quota_limited_papers") > 0)
    late, errors, done = F.col("timeout_count") > 0, (F.col("gemini_error_count") > 0) | (F.col("model_unavailable_count") > 0), F.col("successful")
    return (
        F.when(done & quota, "complete_with_quota_limit").when(done & late, "complete_with_timeout").when(done & errors, "complete_recovered_gemini_errors").when(done, "complete_clean")
        .when(quota, "quota_limited").when(late, "timeout").when(errors, "gemini_api_failure")
        .when((F.col("gemini_api_calls") == 0) & (F.col("output_rows") == 0), "upstream_metadata_or_fulltext_failure")
        .when(F.col("return_code") != 0, "runner_error").otherwise("partial_or_unclassified_failure")
    )


def block_summary(batches: DataFrame) -> DataFrame:
    """Per time block: runs, and medians over its successful runs, or over all if none was."""
    good = lambda c: F.coalesce(F.median(F.when(F.col("successful"), F.col(c).cast("double"))), F.median(F.col(c).cast("double")), F.lit(0.0))
    return batches.groupBy("time_block").agg(
        F.count("*").alias("runs"), F.count_if("successful").alias("successful_runs"), good("runtime_seconds").alias("median_runtime_seconds"),
        F.median("completion_rate").alias("median_completion_rate"), F.count_if(F.col("quota_limited_rows") > 0).alias("quota_limited_runs"),
        F.count_if(F.col("model_unavailable_count") > 0).alias("model_unavailable_runs"), F.count_if(F.col("timeout_count") > 0).alias("timeout_runs"),
        F.count_if(F.col("failure_class") == "upstream_metadata_or_fulltext_failure").alias("upstream_failure_runs"), good("output_rows").alias("median_output_rows"),
        good("gemini_api_calls").alias("median_api_calls"), good("gemini_total_tokens").alias("median_total_tokens"),
    )


def verdict(batches: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: how usable the service was, by an ordered list of rules."""
    b = batches.agg(
        F.count("*").alias("n"), F.coalesce(F.median("completion_rate"), F.lit(0.0)).alias("completion"), F.coalesce(F.median("runtime_seconds"), F.lit(0.0)).alias("runtime"),
        F.count_if((F.col("quota_limited_rows") > 0) | (F.col("timeout_count") > 0) | (F.col("permission_denied_count") > 0)).alias("limited"), F.count_if(F.col("failed_papers") > 0).alias("failed"),
    )
    positive = F.when(F.col("median_runtime_seconds") > 0, F.col("median_runtime_seconds"))
    k = blocks.agg(F.count("*").alias("blocks"), F.when(F.count(positive) >= 2, F.max(positive) / F.min(positive)).otherwise(1.0).alias("ratio"))
    done = F.col("completion")
    return b.crossJoin(k).select(
        F.when(F.col("n") == 0, "no_data").when(done < C.LEAST_COMPLETION, "not_usable")
        .when(F.col("limited") > 0, F.when(done < C.GOOD_COMPLETION, "not_usable").otherwise("marginal")).when(F.col("blocks") < C.LEAST_BLOCKS, "insufficient_data")
        .when((done >= C.GOOD_COMPLETION) & (F.col("runtime") <= C.LONGEST_RUNTIME_S) & (F.col("ratio") <= C.LARGEST_BLOCK_RATIO) & (F.col("failed") == 0), "usable")
        .otherwise("marginal").alias("verdict"), "n", done, "runtime", "ratio",
    )


def mean_pairwise_jaccard(sets: DataFrame, key: str, run: str, items: str) -> DataFrame:
    """Mean Jaccard similarity over all pairs of a key's runs; two empty sets are alike; null below two runs.

    Runs of one key pair up by an equi-join on the key, never across keys.
    """
    a, b = sets.select(key, F.col(run).alias("r1"), F.col(items).alias("s1")), sets.select(key, F.col(run).alias("r2"), F.col(items).alias("s2"))
    union = F.size(F.array_union("s1", "s2"))
    pair = a.join(b, key).where("r1 < r2").select(key, F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("s1", "s2")) / union).alias("j"))
    return sets.select(key).distinct().join(pair.groupBy(key).agg(F.avg("j").alias("mean_jaccard")), key, "left")


def stability(observed: DataFrame, reported: DataFrame) -> DataFrame:
    """Per paper over runs: row statistics, drop rates and mean Jaccard of gene and gene-variant sets.

    observed has run_id, pmid, rows, genes, gene_variants (from outputs);
    reported has run_id, pmid, emitted_rows, strict_gate_drops, citation_gate_drops.
    """
    none = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    o = observed.join(reported, ["run_id", "pmid"], "full").withColumns({"genes": F.coalesce("genes", none), "gene_variants": F.coalesce("gene_variants", none)})
    emitted = F.when(zero("emitted_rows") == 0, zero("rows")).otherwise(zero("emitted_rows"))
    o = o.withColumns({"emitted": emitted, "strict": zero("strict_gate_drops"), "cited": zero("citation_gate_drops")})
    o = o.withColumn("drop_rate", F.when(F.col("emitted") + F.col("strict") + F.col("cited") > 0, (F.col("strict") + F.col("cited")) / (F.col("emitted") + F.col("strict") + F.col("cited"))).otherwise(0.0))
    stats = o.groupBy("pmid").agg(
        F.count("*").alias("runs"), F.avg("emitted").alias("mean_rows"), F.coalesce(F.stddev_samp("emitted"), F.lit(0.0)).alias("sd_rows"), F.min("emitted").alias("min_rows"),
        F.max("emitted").alias("max_rows"), F.avg("strict").alias("mean_strict_drops"), F.avg("cited").alias("mean_citation_drops"), F.avg("drop_rate").alias("mean_drop_rate"),
    ).withColumn("cv_rows", F.when(F.col("mean_rows") != 0, F.col("sd_rows") / F.col("mean_rows")).otherwise(0.0))
    for items, name in (("genes", "gene_jaccard"), ("gene_variants", "gene_variant_jaccard")):
        stats = stats.join(mean_pairwise_jaccard(o, "pmid", "run_id", items).withColumnRenamed("mean_jaccard", name), "pmid", "left")
    return stats


def time_block(ts: Column | str) -> Column:
    h = F.hour(ts)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def quota_window(ts: Column | str, reset_hour: int = C.QUOTA_RESET_HOUR) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(c - F.make_interval(hours=F.lit(reset_hour)))


def schedule(bounds: DataFrame) -> DataFrame:
    """Hourly slots from bounds (start_at, hours): the first at the next full hour."""
    hour = F.date_trunc("hour", "start_at")
    first = F.when(hour == F.col("start_at"), hour).otherwise(hour + F.expr("INTERVAL 1 HOUR"))
    s = bounds.select(F.explode(F.sequence(first, first + F.make_interval(hours=F.col("hours") - 1), F.expr("INTERVAL 1 HOUR"))).alias("planned_at"))
    return s.select("planned_at", F.concat(F.lit("hour"), F.date_format("planned_at", "HH")).alias("run_id"), time_block("planned_at").alias("time_block"), F.date_format("planned_at", "HH:mm").alias("planned_local_time"), F.to_date("planned_at").alias("planned_date"), quota_window("planned_at").alias("quota_window"))


def is_late(planned: Column, started: Column, minutes: int = C.LATE_MINUTES) -> Column:
    return started > planned + F.make_interval(mins=F.lit(minutes))


def headroom(slots: DataFrame, by: list[str], most: int = 480, estimate: int = C.ESTIMATED_CALLS) -> DataFrame:
    """Whether each slot of a session runs, slot by slot: it is skipped when its window's calls and the projection exceed a limit.

    A skipped slot adds no calls, which changes all later decisions; so a session's
    slots, a bounded list, are folded in order.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        total = runs = 0
        rows = []
        for r in pdf.sort_values("slot").itertuples(index=False):
            projected = max(estimate, round(total / runs)) if runs else estimate
            before = used.get(r.quota_window, 0)
            go = before + projected <= most
            if go:
                used[r.quota_window], total, runs = before + r.calls, total + r.calls, runs + 1
            rows.append((*[getattr(r, k) for k in by], r.slot, r.quota_window, before, projected, "run" if go else "skipped_call_headroom"))
        return pd.DataFrame(rows, columns=[*by, "slot", "quota_window", "window_calls", "projected", "status"])

    kinds = dict(slots.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), f"slot {kinds['slot']}", f"quota_window {kinds['quota_window']}", "window_calls long", "projected long", "status string"])
    return slots.select(*by, "slot", "quota_window", "calls").groupBy(*by).applyInPandas(fold, schema)


def paced(requests: DataFrame, key: str, order: list[str], arrival: str, gap: int) -> DataFrame:
    """When each request of a key is sent (started), if one follows another by at least gap: at its arrival or gap after the one before.

    Sending times have a closed form, a running maximum, so no request waits on a
    fold: the latest of all earlier arrivals, each moved on by the gaps since.
    """
    w = Window.partitionBy(key).orderBy(*order)
    r = requests.withColumn("_i", F.row_number().over(w).cast("long") * gap)
    return r.withColumn("started", F.max(F.col(arrival) - F.col("_i")).over(w) + F.col("_i")).drop("_i")


def attempt_outcomes(attempts: DataFrame, pool: list[str], started: str, seconds: str, limit: float) -> DataFrame:
    """outcome of each attempt: done, timed_out (over the limit, not tried again) or resubmitted (in flight when its pool was rebuilt).

    A pool is rebuilt when its first attempt times out. Attempts that begin later
    belong to the rebuilt pool and count as done or timed out by their own time.
    """
    over = F.col(seconds) > limit
    rebuilt = attempts.groupBy(*pool).agg(F.min(F.when(over, F.col(started) + limit)).alias("_rebuilt"))
    flying = (F.col(started) < F.col("_rebuilt")) & (F.col(started) + F.least(F.col(seconds), F.lit(limit)) > F.col("_rebuilt"))
    outcome = F.when(flying, "resubmitted").when(over, "timed_out").otherwise("done")
    return attempts.join(rebuilt, pool).withColumn("outcome", outcome).drop("_rebuilt")


def failure_streaks(runs: DataFrame, key: str, order: str, failed: str, stop_at: int = C.FAILURES_IN_A_ROW) -> DataFrame:
    """Consecutive failures up to each run of a key, and whether the key stops there (first time that stop_at is reached)."""
    w = Window.partitionBy(key).orderBy(order)
    r = runs.withColumn("_island", F.sum((~F.col(failed)).cast("int")).over(w))
    r = r.withColumn("streak", F.sum(F.col(failed).cast("int")).over(Window.partitionBy(key, "_island").orderBy(order)))
    return r.withColumn("stops", (F.col("streak") == stop_at) & (F.count_if(F.col("streak") >= stop_at).over(w) == 1)).drop("_island")


def fingerprint(ids: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """SHA-256 of a corpus's ids in order, joined by line feeds; a corpus list is bounded by design."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("string").alias("v")))), lambda x: x["v"]), "\n")
    return ids.groupBy(*by).agg(F.sha2(joined, 256).alias("fingerprint"), F.count("*").alias("n"))


def nice_ticks(largest: float, count: int = 5) -> list[float]:
    """Axis ticks in steps of 1, 2 or 5 times a power of ten."""
    import math

    if largest <= 0:
        return [0.0, 1.0]
    power = 10 ** math.floor(math.log10(largest / max(count, 1)))
    step = next(s * power for s in (1, 2, 5, 10) if s * power * count >= largest)
    return [k * step for k in range(math.ceil(largest / step) + 1)]


def report(verdicts: DataFrame, blocks: DataFrame) -> Iterator[str]:
    """Markdown lines of small aggregates."""
    v = verdicts.first()
    yield f"# Run report\n\nVerdict: {v['verdict']}\n"
    columns = blocks.columns
    yield "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"
    for r in blocks.orderBy("time_block").toLocalIterator():
        yield "| " + " | ".join(f"{x:.4g}" if isinstance(x, float) else str(x) for x in r) + " |"
