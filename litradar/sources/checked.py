"""Sources with broken records: good records go on, the others are kept aside and counted."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .readers import ARTICLE_PAGE, FEED_ENTRY, parse_article_items, parse_feed_entries, union_sources

BROKEN = "_corrupt_record"


@dataclass(frozen=True)
class LandedSource:
    """A landed format: how its files are read and how raw rows become candidates."""

    name: str
    format: str
    schema: str
    parse: Callable[[DataFrame], DataFrame]
    options: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class CheckedRead:
    """``works``: all good candidates; ``quarantine(source, file, record)``; ``report(source, state, files, silent_files, records, broken)``."""

    works: DataFrame | None
    quarantine: DataFrame
    report: DataFrame


def article_source(name: str = "crossref", multi_line: bool = True) -> LandedSource:
    return LandedSource(name, "json", ARTICLE_PAGE, lambda raw: parse_article_items(raw.select(F.explode("message.items").alias("item"))), {"multiLine": str(multi_line).lower()})


def preprint_source(name: str = "arxiv", categories: Sequence[str] | None = None) -> LandedSource:
    return LandedSource(name, "xml", FEED_ENTRY, lambda raw: parse_feed_entries(raw, categories), {"rowTag": "entry"})


def _raw(spark: SparkSession, source: LandedSource, path: str) -> DataFrame:
    """Raw rows with the text of broken records and ``_file``."""
    schema, file = f"{source.schema}, {BROKEN} string", F.col("_metadata.file_path").alias("_file")
    permissive = {**source.options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    if source.format != "xml":
        return spark.read.format(source.format).schema(schema).options(**permissive, ignoreCorruptFiles="true").load(path).select("*", file)
    # a reader of whole files gives up at the first broken element; here each element is parsed by itself
    tag = source.options["rowTag"]
    pieces = spark.read.options(lineSep=f"</{tag}>", ignoreCorruptFiles="true").text(path).select("value", file)
    element = F.concat(F.regexp_extract("value", rf"(?s)<{tag}[\s>].*", 0), F.lit(f"</{tag}>"))
    parsed = pieces.where(F.col("value").rlike(rf"<{tag}[\s>]")).select(F.from_xml(element, schema, permissive).alias("x"), "_file")
    return parsed.select("x.*", "_file")


def read_checked(spark: SparkSession, sources: Sequence[LandedSource], paths: Mapping[str, str]) -> CheckedRead:
    """Read the sources that have a path, in the order given.

    A record that does not parse, or not to the types of its source, goes to the quarantine with its file and text. A file
    that cannot be read at all (cut off, not of its format) is passed over and counted as silent. A source that cannot
    be opened is ``failed``, one with anything broken or silent ``damaged``; neither ends the run.
    """
    frames, aside, reports = [], [], []
    nothing = spark.createDataFrame([], "source string, file string, record string")
    for priority, source in enumerate(s for s in sources if s.name in paths):
        path = paths[source.name]
        try:
            raw = _raw(spark, source, path)
            files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
        except AnalysisException:
            reports.append(spark.range(1).select(F.lit(source.name).alias("source"), F.lit("failed").alias("state"), *[F.lit(0).cast("long").alias(c) for c in ("files", "silent_files", "records", "broken")]))
            continue
        # what was read is written: a record's text is known only while its file is parsed
        held = cut_lineage(raw)
        good = held.where(F.col(BROKEN).isNull()).drop(BROKEN, "_file")
        frames.append(source.parse(good).withColumn("source_priority", F.lit(priority)))
        aside.append(held.where(F.col(BROKEN).isNotNull()).select(F.lit(source.name).alias("source"), F.col("_file").alias("file"), F.col(BROKEN).alias("record")))
        plain = F.regexp_replace("file", "^file:/*", "/")
        spoke = held.select(F.col("_file").alias("file")).distinct().select(plain.alias("file"), F.lit(1).alias("spoke"))
        listed = files.select(plain.alias("file")).join(spoke, "file", "left").agg(F.count("*").alias("files"), F.count_if(F.col("spoke").isNull()).alias("silent_files"))
        counts = held.agg(F.count_if(F.col(BROKEN).isNull()).alias("records"), F.count_if(F.col(BROKEN).isNotNull()).alias("broken"))
        state = F.when((F.col("broken") > 0) | (F.col("silent_files") > 0), "damaged").otherwise("whole")
        reports.append(listed.crossJoin(counts).select(F.lit(source.name).alias("source"), state.alias("state"), "files", "silent_files", "records", "broken"))
    quarantine, report = nothing, None
    for part in aside:
        quarantine = quarantine.union(part)
    for part in reports:
        report = part if report is None else report.union(part)
    if report is None:
        report = spark.createDataFrame([], "source string, state string, files long, silent_files long, records long, broken long")
    return CheckedRead(union_sources(frames), quarantine, report)
