"""Run artifacts: debug and audit payloads, manifests, trace archives, report tables, plot data, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .output import candidate_audit
from .runs import linear_quantile


def drop_debug(papers: DataFrame, run: dict[str, str]) -> DataFrame:
    """One JSON text a paper of its debug columns, with the run's parameters: JSON Lines instead of one unbounded document."""
    about = F.struct(*[F.lit(v).alias(k) for k, v in sorted(run.items())])
    return papers.select("pmid", F.to_json(F.struct(about.alias("run"), F.struct(*[F.col(f"`{c}`") for c in papers.columns]).alias("paper_debug"))).alias("payload"))


def audit_payload(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidate audit as JSON texts, one a paper."""
    a = candidate_audit(papers, rows)
    return a.select("pmid", F.to_json(F.struct(F.lit("candidate_audit_v1").alias("schema_version"), *[F.col(f"`{c}`") for c in a.columns])).alias("payload"))


def candidate_lifecycle(candidates: DataFrame) -> DataFrame:
    """Each paper's candidates as one JSON list; a paper's candidates are bounded by its text."""
    return candidates.groupBy("pmid").agg(F.to_json(F.array_sort(F.collect_list(F.struct("gene", "variant", "sources", "outcome")))).alias("candidates"), F.count("*").alias("candidate_count"))


def manifest(runs: DataFrame, batch: DataFrame, papers: DataFrame, key: str = "run_id") -> DataFrame:
    """Run manifests: a run's fields, its batch counters as a struct and its papers as a list by id."""
    b = batch.select(key, F.struct(*[F.col(c) for c in batch.columns if c != key]).alias("batch"))
    p = papers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pmid", *[c for c in papers.columns if c not in (key, "pmid")]))).alias("per_paper"))
    return runs.join(b, key, "left").join(p, key, "left")


def paper_summary(papers: DataFrame, debug: DataFrame, audit: DataFrame, fetch: DataFrame) -> DataFrame:
    """Papers with their debug, audit and fetch records; what is missing is 0 or blank."""
    joined = papers.join(debug, "pmid", "left").join(audit, "pmid", "left").join(fetch, "pmid", "left")
    numbers = [f.name for f in joined.schema if f.dataType.typeName() in ("integer", "long", "double")]
    return joined.na.fill(0, numbers).na.fill("", [f.name for f in joined.schema if f.dataType.typeName() == "string" and f.name != "pmid"])


def report_table(parts: list[DataFrame]) -> DataFrame:
    """Tables of different columns as one, its columns sorted by name."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.select(*[F.col(f"`{c}`") for c in sorted(both.columns)])


def box_data(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Five numbers a box plot shows, by linear interpolation."""
    return rows.groupBy(by).agg(F.min(value).alias("min"), *[linear_quantile(value, q).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], F.max(value).alias("max"))


def matrix_data(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A matrix for a heat map; its columns are given, so that no job looks for them."""
    return rows.groupBy(row).pivot(column, columns).agg(F.first(value))


def trace_archive(events: DataFrame) -> DataFrame:
    """The latest event of each node as JSON, with the number of events of its stage."""
    stage = events.groupBy("stage_id").agg(F.count("*").alias("stage_events"))
    last = events.groupBy("node_id").agg(F.max_by(F.struct("stage_id", "pmid", "captured_at"), "captured_at").alias("e")).select("node_id", "e.*")
    return last.join(stage, "stage_id", "left").select("node_id", F.to_json(F.struct("stage_id", "pmid", "captured_at", "stage_events")).alias("payload"))


def table_prompt(tables: Column, most_tables: int = 20, most_rows: int = 20) -> Column:
    """Tables as text: label, then rows with bars between cells, both capped."""
    def shown(t: Column) -> Column:
        return F.concat(t["label"], F.lit("\n"), F.array_join(F.transform(F.slice(t["rows"], 1, most_rows), lambda r: F.array_join(r, " | ")), "\n"))

    return F.array_join(F.transform(F.slice(tables, 1, most_tables), shown), "\n\n")


def run_counters(rows: DataFrame) -> DataFrame:
    """Rows, papers, distinct genes of each paper, quota papers and rows over a run."""
    quota = F.coalesce("quota_limited", F.lit(False))
    per = rows.groupBy("pmid").agg(F.count("*").alias("rows"), F.countDistinct(F.nullif(F.upper(F.trim("gene")), F.lit(""))).alias("genes"), F.count_if(quota).alias("quota_rows"))
    return per.agg(F.count("*").alias("papers"), F.sum("rows").alias("rows"), F.sum("genes").alias("genes"), F.sum("quota_rows").alias("quota_rows"), F.count_if(F.col("quota_rows") > 0).alias("quota_papers"))


def planned_label(planned: Column, run: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(planned), F.lit("")), F.trim(run))


def display_confidence(level: Column) -> Column:
    return F.when(level == "HIGH", "Strong").when(level == "MEDIUM", "Moderate").when(level == "LOW", "Weak").otherwise("Needs review")


def added_since(selected: DataFrame, original: DataFrame) -> DataFrame:
    return selected.join(original, "pmid", "left_anti")


def workbook(primary: DataFrame, meta: DataFrame, path: str) -> bool:
    """Writes a workbook of both tables and one sheet a group, on the driver, where openpyxl is there; says whether it did.

    A workbook is made for reading: more rows than a sheet can hold are an error, not cut.
    """
    most = 1_048_575
    try:
        from openpyxl import Workbook
        from openpyxl.styles import PatternFill
    except ImportError:
        return False
    fills = {"HIGH": "D4EDDA", "MEDIUM": "FFF9C4", "LOW": "FFE0B2", "REVIEW": "FCE4EC"}
    book = Workbook()

    def sheet(title: str, df: DataFrame) -> None:
        if df.limit(most + 1).count() > most:
            raise ValueError(f"{title}: more rows than a sheet holds")
        ws = book.create_sheet(title[:31])
        ws.append(df.columns)
        colour = df.columns.index("Confidence") + 1 if "Confidence" in df.columns else 0
        for r in df.toLocalIterator():
            ws.append(["" if x is None else str(x) for x in r])
            if colour and (fill := fills.get(r["Confidence"])):
                ws.cell(ws.max_row, colour).fill = PatternFill("solid", fgColor=fill)
        ws.freeze_panes = "A2"

    book.remove(book.active)
    sheet("Results", primary)
    sheet("Metadata", meta)
    if "Association Group" in primary.columns:
        for (group,) in primary.select("`Association Group`").distinct().orderBy("`Association Group`").collect():
            sheet("".join(c for c in str(group or "Unclassified") if c not in r"[]:*?/\\"), primary.where(F.col("`Association Group`").eqNullSafe(group)))
    book.save(path)
    return True


def latex_rows(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """order and line: each row as a line of a LaTeX table, cells with one decimal where they are fractions, special characters escaped, -- for null."""
    kinds = dict(rows.dtypes)

    def cell(c: str) -> Column:
        if kinds[c] in ("double", "float") or kinds[c].startswith("decimal"):
            value = F.when(F.col(c).isNotNull(), F.format_string("%.1f", F.col(c).cast("double")))
        else:
            value = F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\textbackslash ")), r"([&%$#_{}])", r"\\$1")
        return F.coalesce(value, F.lit("--"))

    return rows.select(*order, F.concat(F.concat_ws(" & ", *[cell(c) for c in columns]), F.lit(" \\\\")).alias("line"))


def latex_table(lines: list[str], titles: list[str], caption: str, label: str) -> str:
    """A LaTeX table of lines that latex_rows made of a small aggregate."""
    head = ["\\begin{table}", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{{'l' + 'r' * (len(titles) - 1)}}}", "\\hline", " & ".join(titles) + " \\\\", "\\hline"]
    return "\n".join([*head, *lines, "\\hline", "\\end{tabular}", "\\end{table}"])
