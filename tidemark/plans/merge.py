"""Reports of ranks to one: a union, checks, and a top-K over all of them; once, or as a stream of reports that arrive."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.times import required_time
from tidemark.model import CATEGORIES, ReportConfig
from tidemark.operators import rules as R
from tidemark.plans.report import REPORT_VERSION, _finding
from tidemark.sinks import documents as D
from tidemark.sinks import store
from tidemark.sources.reports import arriving_reports, findings_of, rank_reports


def rank_coverage(ranks: DataFrame) -> DataFrame:
    """One row of (rank, world_size, updated_at, truncated) rows: expected and present ranks, completeness, the latest update, and truncated reports.

    Updates are text and compared as instants; one that is no time with a zone is an error, null is unknown. A rank with two reports and
    reports of runs of different sizes are errors.
    """
    at = required_time(F.col("updated_at"), "updated_at of a rank report")
    each = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("world_size").alias("low"), F.max("world_size").alias("high"), F.max(F.struct(at.alias("at"), "updated_at")).alias("updated"), F.sum(F.col("truncated").cast("int")).alias("truncated"))
    one = each.agg(
        F.max("n").alias("n"), F.max_by("rank", "n").alias("worst"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("updated")["updated_at"].alias("updated_at"),
        F.sort_array(F.collect_list("rank")).alias("present"), F.sum("truncated").cast("long").alias("source_reports_truncated"),
    )
    wrong = lambda *what: F.raise_error(F.concat(*(F.lit(w) if isinstance(w, str) else w.cast("string") for w in what))).cast("int")
    checked = F.when(F.col("n") > 1, wrong("rank ", F.col("worst"), " has ", F.col("n"), " reports"))
    checked = checked.when(F.col("low") <= 0, wrong("a report says that its run has ", F.col("low"), " ranks"))
    checked = checked.when(F.col("low") != F.col("high"), wrong("the reports are of runs of different sizes: ", F.col("low"), " and ", F.col("high"), " ranks")).otherwise(F.col("high"))
    one = one.withColumn("expected_ranks", checked)
    complete = F.col("present") == F.sequence(F.lit(0), F.col("expected_ranks") - 1)
    return one.select("expected_ranks", F.col("present").alias("ranks_present"), complete.alias("rank_coverage_complete"), "updated_at", "source_reports_truncated")


def missing_ranks(ranks: DataFrame, world_size: int) -> DataFrame:
    """Expected ranks of which there is no report."""
    return ranks.sparkSession.range(world_size).select(F.col("id").cast("int").alias("rank")).join(ranks.select("rank"), "rank", "left_anti")


def global_top(findings: DataFrame, k: int = 20) -> DataFrame:
    """The k best findings of each category over all ranks, ranked anew."""
    known = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise(F.raise_error(F.concat(F.lit("unknown category "), F.col("category"))).cast("string"))
    w = Window.partitionBy("category").orderBy(F.desc("ranking_score"), "source_rank", *R.ORDER)
    return findings.withColumn("category", known).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_rank_reports(spark: SparkSession, root: str, output: object = None, config: ReportConfig = ReportConfig()) -> tuple[str, str]:
    """Write global-report.json and global-index.md of the reports under root; what reaches the driver is K findings a category."""
    return _merged(rank_reports(spark, root), output if output is not None else root, config)


def _merged(reports: DataFrame, folder: object, config: ReportConfig) -> tuple[str, str]:
    """Write the global documents of reports, a row a rank, into the folder."""
    reports = reports.persist()
    try:
        r = F.col("report")
        ranks = reports.select(r["rank"]["rank"].alias("rank"), r["rank"]["world_size"].alias("world_size"), r["updated_at"].alias("updated_at"), r["coverage"]["report_truncated_by_byte_budget"].alias("truncated"))
        cover = rank_coverage(ranks).first()
        found = findings_of(reports)
        total = found.count()
        best = R.round_robin(global_top(found, config.top_k_per_category).select(*R.FINDING)).collect()
    finally:
        reports.unpersist()
    coverage = {
        "expected_ranks": cover["expected_ranks"], "ranks_present": list(cover["ranks_present"]), "rank_coverage_complete": cover["rank_coverage_complete"], "source_reports_truncated": cover["source_reports_truncated"],
        "findings_returned": 0, "findings_omitted_after_global_ranking": total, "report_truncated_by_byte_budget": False,
    }
    report = {"report_schema_version": REPORT_VERSION, "updated_at": cover["updated_at"] or D.absent("no report has a time"), "report_configuration": asdict(config), "coverage": coverage, "findings": D.by_category([])}
    report = D.within_budget(report, [_finding(f) for f in best], config.max_bytes, "findings_omitted_after_global_ranking", total)
    if D.json_bytes(report) > config.max_bytes:
        raise ValueError("the merged report without findings exceeds max_bytes")
    return D.publish(store.join(folder, "global-report.json"), D.json_text(report)), D.publish(store.join(folder, "global-index.md"), D.merged_markdown(report))


def latest_reports(reports: DataFrame) -> DataFrame:
    """rank, path, report: the latest report of each rank, by its time and then by its path; one without a time is older than any other.

    Of a stream this is the state of its query: a row a rank, however many reports arrive.
    """
    at = required_time(F.col("report.updated_at"), "updated_at of a rank report")
    newest = F.max_by(F.struct("path", "report"), F.struct(at, "path"))
    return reports.groupBy(F.col("report.rank.rank").alias("rank")).agg(newest.alias("newest")).select("rank", "newest.*")


def stream_rank_reports(
    spark: SparkSession, root: str, output: object = None, config: ReportConfig = ReportConfig(), *, checkpoint: str | None = None, trigger: dict | None = None, files: str = "rank-*/report*.json", at_once: int | None = None
) -> StreamingQuery:
    """Start a query that keeps global-report.json and global-index.md up to date with the reports of ranks as they arrive under root.

    A later report of a rank replaces the one before, in whatever order they are read; one that arrives twice changes nothing. Until all ranks have reported,
    rank_coverage_complete is false. checkpoint: the folder of the query's state, by default <output>.merging; the same call goes on
    after a stop without reading old files again. Reports of runs of different sizes, and files that are no reports, stop the query.
    """
    folder = str(output if output is not None else root).rstrip("/")
    latest = latest_reports(arriving_reports(spark, root, files, at_once))

    def publish(known: DataFrame, batch_id: int) -> None:
        known = known.persist()  # the state is read once
        try:
            if not known.isEmpty():
                _merged(known, folder, config)
        finally:
            known.unpersist()

    return latest.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint or f"{folder}.merging").trigger(**(trigger or {"availableNow": True})).start()
