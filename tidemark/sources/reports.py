"""Reports of ranks as a table: read as text, parsed with the full schema, checked, one row a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import required_time, time_text
from tidemark.sources.adapters import rank_of_path

POINT = "struct<value: double, sample_id: bigint, timestamp: string>"
FINDING = (
    "struct<category: string, rank: int, ranking_score: double, ranking_basis: string, source_rank: int, module: string, module_type: string, call_index: int, signal: string, tensor_path: string, "
    f"metric: string, observations: bigint, warmup_complete: boolean, first: {POINT}, latest: {POINT}, minimum: {POINT}, maximum: {POINT}, evidence: array<struct<name: string, value: double>>, interpretation: string>"
)
#: A time that is absent is an object with the reason, which is read as its JSON.
REPORT = (
    "struct<updated_at: string, rank: struct<rank: int, world_size: int>, coverage: struct<report_truncated_by_byte_budget: boolean>, "
    f"findings: array<struct<category: string, findings: array<{FINDING}>>>>"
)


def _required(report: Column, path: Column) -> Column:
    """report, or an error that names the file and what is wrong with it."""
    bad = lambda what: F.raise_error(F.concat(F.lit(what), F.lit(": "), path)).cast(REPORT)
    out = report
    for name in ("updated_at", "rank", "coverage", "findings"):
        out = F.when(report[name].isNull(), bad(f"{name} is missing")).otherwise(out)
    size, rank = report["rank"]["world_size"], report["rank"]["rank"]
    out = F.when(size.isNull() | (size <= 0) | rank.isNull() | (rank < 0) | (rank >= size), bad("rank and world_size do not fit")).otherwise(out)
    return F.when(report.isNull(), bad("this is no JSON object")).otherwise(out)


def rank_reports(spark: SparkSession, root: str) -> DataFrame:
    """path, path_rank, report of every rank-*/report.json under root; there must be one."""
    glob = f"{root.rstrip('/')}/rank-*/report.json"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(glob)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise FileNotFoundError(f"there are no rank reports under {root}")
    return _parsed(spark.read.text(glob, wholetext=True).select("value", F.input_file_name().alias("path")))


def arriving_reports(spark: SparkSession, root: str, files: str = "rank-*/report*.json", at_once: int | None = None) -> DataFrame:
    """A stream of path, path_rank, report of the files under root, each read once, as it appears. A rank that reports again writes a further file.

    at_once: files a micro-batch at most.
    """
    source = spark.readStream.format("text").option("wholetext", True)
    source = source if at_once is None else source.option("maxFilesPerTrigger", at_once)
    return _parsed(source.load(f"{root.rstrip('/')}/{files}").select("value", F.col("_metadata.file_path").alias("path")))


def _parsed(text: DataFrame) -> DataFrame:
    """path, path_rank, report of value and path."""
    read = text.select("path", rank_of_path(F.col("path")).alias("path_rank"), _required(F.from_json("value", REPORT, {"mode": "FAILFAST"}), F.col("path")).alias("report"))
    # An absent time is null; the times of points must be times, as all else is typed.
    updated = F.when(~F.col("report.updated_at").startswith("{"), F.col("report.updated_at"))
    timed = lambda f: f.withField("first", _timed(f["first"])).withField("latest", _timed(f["latest"])).withField("minimum", _timed(f["minimum"])).withField("maximum", _timed(f["maximum"]))
    groups = F.transform("report.findings", lambda g: g.withField("findings", F.transform(g["findings"], timed)))
    return read.withColumn("report", F.col("report").withField("updated_at", updated).withField("findings", groups))


def _timed(point: Column) -> Column:
    """The point, whose time must be one if it is there; as UTC text."""
    return F.when(point.isNotNull(), point.withField("timestamp", time_text(required_time(point["timestamp"], "the time of a point"))))


def findings_of(reports: DataFrame) -> DataFrame:
    """A row for each finding of the reports, with the report's rank."""
    groups = reports.select(F.col("report.rank.rank").alias("report_rank"), F.explode("report.findings").alias("g"))
    return groups.select("report_rank", F.col("g.category").alias("group_category"), F.explode("g.findings").alias("f")).select("report_rank", "group_category", "f.*")
