"""One query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.parsing import with_fields
from logloom.functions.redaction import EXTENDED_RULES, redact_text
from logloom.functions.severity import severity_rank
from logloom.functions.time import milliseconds
from logloom.operators import compare, dedupe, facets, filters, ingest, paging, semantics, timing
from logloom.operators.findings import land_findings
from logloom.operators.redact import redact
from logloom.plans import bridge, commands, report
from logloom.plans.log_query import LogQuery
from logloom.plans.profiles import load_profile
from logloom.schema import EVENT_COLUMNS, assert_event_schema
from logloom.session import tune
from logloom.sinks import event_files as sinks
from logloom.sources import event_files as sources
from logloom.sources import lake
from logloom.sources.lines import read_lines, scan_lines
from logloom.sources.scratch import scratch_path
from logloom.streaming import event_stream
from logloom.streaming.burst_state import BurstState

JOINT = "\x1f"
PROFILE = load_profile("ue-default")
COMPOUND = LogQuery.from_options(
    category="lognet, LogOnline,LOGTRAVEL",
    exclude_category="logtravel",
    min_level="display",
    contains="SESSION",
    since="00:30:00",
    until="12.00:00:00",
)
PATTERNS = load_profile(
    {
        "name": "patterns",
        "field_patterns": {"Failure": r"(\w+Failure)\b", "code": r"code=(\d+)", "a": r"(?:^| )a=(\d)"},
        "dedupe_patterns": {"code": r"code=\d+", "delay": r"after -?\d+"},
    }
)
LEFT, RIGHT = "src0", "src1"
CONTEXT = ("src1", 40, 5, 7)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.parsed_events(spark, sf_dir)


def heads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without their continuation lines, for jobs that do not look at them: no text is regrouped."""
    return bridge.parsed_events(spark, sf_dir, ingest.ParserOptions(include_continuation_lines=False))


def heads_and_bases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as ``heads_of``, and the base times taken from the prefixes of the same lines."""
    lines = bridge.log_lines(spark, sf_dir)
    options = ingest.ParserOptions(include_continuation_lines=False)
    return ingest.parse_events(lines, options, contiguous=True), ingest.base_timestamps(lines, contiguous=True)


def block_rows(spark: SparkSession, sf_dir: str) -> int:
    return bridge.event_block_rows(spark, sf_dir)


def joined(column: str = "continuation_lines") -> Column:
    return F.array_join(column, JOINT).alias("continuation")


def fields_text(column: str = "fields") -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(e["key"], e["value"])))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), JOINT).alias("fields")


def flat(events: DataFrame, *extra: str | Column) -> DataFrame:
    return events.select(
        "source_id",
        "source_path",
        "line_number",
        "timestamp",
        "frame",
        "category",
        "verbosity",
        "message",
        joined(),
        fields_text(),
        "raw_text_hash",
        *extra,
    )


def short(events: DataFrame, *extra: str | Column) -> DataFrame:
    return events.select("source_id", "line_number", "category", "verbosity", "message", *extra)


def ms(interval: Column | str, name: str) -> Column:
    return milliseconds(F.col(interval) if isinstance(interval, str) else interval).alias(name)


# --- sources and sinks ---------------------------------------------------------


def log_folder(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """The raw lines as text files: of each source, a file for every so many events."""
    path = scratch_path(spark, "log-text")
    keys = ["source_id", "file"]
    (
        bridge.raw_lines(spark, sf_dir)
        .withColumn("file", bridge.file_number())
        .repartition(*keys)
        .sortWithinPartitions(*keys, "pos")
        .select(*keys, "value")
        .write.partitionBy(*keys)
        .text(path, compression=compression)
    )
    return f"{path}/*/*/*.txt*"


def file_source() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), r"^.*source_id=([^/]+)/file=([0-9]+)/[^/]*$", "$1-$2")


def whole_source() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"source_id=([^/]+)/file=[0-9]+/[^/]*$", 1)


def file_place() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"/file=([0-9]+)/[^/]*$", 1).cast("long")


@query
def scan_text(spark, sf_dir):
    return scan_lines(spark, log_folder(spark, sf_dir), file_source()).select("source_id", "value")


QUERIES["scan_lines"] = QUERIES.pop("scan_text")


@query
def line_numbering(spark, sf_dir):
    lines = read_lines(spark, log_folder(spark, sf_dir), file_source())
    return ingest.number_lines(lines, contiguous=True).select("source_id", "line_number", "value")


@query
def line_numbering_rotated(spark, sf_dir):
    """The files of a source as one log, each cut into many splits."""
    folder = log_folder(spark, sf_dir)
    # For the splits of the files only: the tables they are made from are read as ever.
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = read_lines(spark, folder, whole_source(), file_place=file_place())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return ingest.number_lines(lines, contiguous=True).select("source_id", "line_number", "value")


@query
def parse_text_files(spark, sf_dir):
    lines = read_lines(spark, log_folder(spark, sf_dir), file_source())
    return short(ingest.parse_events(lines, contiguous=True), "timestamp", "frame", joined(), "raw_text_hash")


@query
def parse_compressed_files(spark, sf_dir):
    """Files that Spark can't split, cut into blocks when they are landed."""
    lines = read_lines(spark, log_folder(spark, sf_dir, "gzip"), file_source(), block_lines=512)
    return short(ingest.parse_events(lines, contiguous=True), "timestamp", "frame", joined(), "raw_text_hash")


@query
def skip_blank_lines(spark, sf_dir):
    numbered = ingest.number_lines(bridge.raw_lines(spark, sf_dir))
    return ingest.drop_blank_lines(numbered).select("source_id", "line_number", "value")


@query
def source_contract(spark, sf_dir):
    return flat(assert_event_schema(events_of(spark, sf_dir)))


@query
def ndjson_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "ndjson")
    sinks.write_text(sinks.to_ndjson(events_of(spark, sf_dir)), path)
    return flat(sources.read_json_events(spark, path))


@query
def sink_json(spark, sf_dir):
    """All columns of the written records, as their JSON texts say them."""
    path = scratch_path(spark, "json")
    sinks.write_json(events_of(spark, sf_dir), path)
    texts = [n for n in EVENT_COLUMNS if n not in ("continuation_lines", "fields")]
    values = F.json_tuple("value", *[sinks.json_name(n) for n in texts]).alias(*texts)
    lists = {"continuation_lines": "array<string>", "fields": "map<string,string>"}
    found = spark.read.text(path).select(
        values, *[F.from_json(F.get_json_object("value", f"$.{sinks.json_name(n)}"), k).alias(n) for n, k in lists.items()]
    )
    return flat(found, "schema_version", "relative_time").withColumns(
        {"line_number": F.col("line_number").cast("bigint"), "frame": F.col("frame").cast("int")}
    )


@query
def event_lake(spark, sf_dir):
    path = scratch_path(spark, "lake")
    lake.write_lake(events_of(spark, sf_dir), path)
    found = lake.read_lake(spark, path, [RIGHT], ["LogNet", "LOGONLINE"], min_verbosity="Warning")
    return flat(found, "category_key", "severity_rank")


@query
def event_lake_loads(spark, sf_dir):
    """All events read back from a lake that was loaded in two steps."""
    path = scratch_path(spark, "lake")
    events = events_of(spark, sf_dir)
    for later in (False, True):
        lake.write_lake(events.where((F.col("source_id") >= "src2") == F.lit(later)), path, buckets=3)
    return flat(lake.read_lake(spark, path), "category_key", "severity_rank")


@query
def filter_text(spark, sf_dir):
    events = heads_of(spark, sf_dir)
    asked = LogQuery.from_options(min_level="Warning")
    return commands.filter_lines(events, asked, PROFILE, normalize=True)


@query
def clean_text(spark, sf_dir):
    return commands.clean(events_of(spark, sf_dir), "exact")


def read_back(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Lines of the text files that ``rows`` are written to, numbered in order of the files' names."""
    path = scratch_path(spark, "text")
    sinks.write_text(rows, path)
    place = F.regexp_extract(F.col("_metadata.file_name"), r"part-([0-9]+)", 1).cast("int")
    lines = read_lines(spark, f"{path}/*.txt", F.lit("text"), file_place=place)
    return ingest.number_lines(lines, contiguous=True).select("line_number", "value")


@query
def filter_text_file(spark, sf_dir):
    """Matched lines through the sink, in log order."""
    return read_back(spark, QUERIES["filter_text"](spark, sf_dir))


@query
def clean_text_file(spark, sf_dir):
    """Clean lines through the sink, in log order."""
    return read_back(spark, QUERIES["clean_text"](spark, sf_dir))


@query
def categories_text(spark, sf_dir):
    return commands.categories(heads_of(spark, sf_dir), PROFILE)


@query
def facet_summary_json(spark, sf_dir):
    return commands.categories(heads_of(spark, sf_dir), PROFILE, as_json=True)


@query
def report_markdown(spark, sf_dir):
    return report.markdown_report(heads_of(spark, sf_dir), PROFILE, entries=5, block_rows=block_rows(spark, sf_dir))


# --- parsing -------------------------------------------------------------------


@query
def parse_prefix(spark, sf_dir):
    return events_of(spark, sf_dir).select("source_id", "line_number", "timestamp", "frame")


@query
def parse_events(spark, sf_dir):
    return short(events_of(spark, sf_dir), "schema_version")


@query
def parse_fallback(spark, sf_dir):
    return short(heads_of(spark, sf_dir).filter(F.col("category") == "Unknown"), "timestamp", "frame")


@query
def head_lines(spark, sf_dir):
    marked = ingest.mark_heads(bridge.log_lines(spark, sf_dir), contiguous=True)
    return marked.select("source_id", "line_number", "is_head", "value")


@query
def event_lines(spark, sf_dir):
    return ingest.assign_event_lines(bridge.log_lines(spark, sf_dir), contiguous=True).select(
        "source_id", "event_line", "is_head", "value"
    )


@query
def event_chunks(spark, sf_dir):
    """The chunks of each event put together again, in order of their blocks."""
    chunks = ingest.stitch_in_chunks(bridge.log_lines(spark, sf_dir), contiguous=True)
    parts = F.sort_array(F.collect_list(F.struct("block", "continuation_lines")))["continuation_lines"]
    whole = chunks.groupBy("source_id", "line_number").agg(F.max("raw").alias("raw"), F.flatten(parts).alias("lines"))
    return whole.select("source_id", "line_number", "raw", joined("lines"))


@query
def stitch_continuations(spark, sf_dir):
    stitched = ingest.stitch_continuations(bridge.log_lines(spark, sf_dir), contiguous=True)
    return stitched.select("source_id", "line_number", "raw", joined())


@query
def parse_no_continuation(spark, sf_dir):
    options = ingest.ParserOptions(include_continuation_lines=False, capture_raw_text_hash=False)
    return flat(bridge.parsed_events(spark, sf_dir, options))


@query
def extract_fields(spark, sf_dir):
    return heads_of(spark, sf_dir).select("source_id", "line_number", "message", fields_text())


@query
def extract_fields_documents(spark, sf_dir):
    documents = bridge.document_events(spark, sf_dir).drop("fields")
    return with_fields(documents).select("source_id", "line_number", fields_text())


@query
def raw_hash(spark, sf_dir):
    return events_of(spark, sf_dir).select("source_id", "line_number", "raw_text_hash")


# --- redaction and projections -------------------------------------------------


@query
def redact_message(spark, sf_dir):
    return heads_of(spark, sf_dir).select("source_id", "line_number", redact_text(F.col("message")).alias("message"))


@query
def redact_continuations(spark, sf_dir):
    return redact(events_of(spark, sf_dir)).select("source_id", "line_number", joined())


@query
def redact_fields(spark, sf_dir):
    return redact(heads_of(spark, sf_dir)).select("source_id", "line_number", fields_text())


@query
def redact_events(spark, sf_dir):
    return flat(redact(events_of(spark, sf_dir)))


@query
def redact_extended(spark, sf_dir):
    return short(redact(heads_of(spark, sf_dir), EXTENDED_RULES))


@query
def profile_fields(spark, sf_dir):
    """The parse command with a profile that has patterns of its own."""
    heads = ingest.ParserOptions(include_continuation_lines=False)
    found = commands.parse(bridge.log_lines(spark, sf_dir), heads, contiguous=True, profile=PATTERNS)
    return found.select("source_id", "line_number", fields_text())


@query
def severity_ranks(spark, sf_dir):
    events = heads_of(spark, sf_dir)
    rank = severity_rank(F.col("verbosity")).cast("bigint").alias("rank")
    return events.groupBy("verbosity", rank).agg(F.count(F.lit(1)).alias("count"))


QUERIES["severity_rank"] = QUERIES.pop("severity_ranks")


# --- filters -------------------------------------------------------------------


@query
def filter_include(spark, sf_dir):
    return short(filters.include_categories(heads_of(spark, sf_dir), ["LOGnet", "LogTravel"]))


@query
def filter_exclude(spark, sf_dir):
    return short(filters.exclude_categories(heads_of(spark, sf_dir), ["logslate", "Unknown"]))


@query
def filter_noise(spark, sf_dir):
    return short(filters.exclude_noise(heads_of(spark, sf_dir), PROFILE))


@query
def filter_noise_join(spark, sf_dir):
    """The same by join, the way long lists go."""
    names = [*PROFILE.noise_categories, *[f"LogUnused{i}" for i in range(filters.INLINE_NAMES)]]
    return short(filters.exclude_categories(heads_of(spark, sf_dir), names))


@query
def filter_min_level(spark, sf_dir):
    return short(filters.min_level(heads_of(spark, sf_dir), "WARNING"))


@query
def filter_contains(spark, sf_dir):
    return short(filters.contains_text(bridge.document_events(spark, sf_dir), "ER th"))


@query
def filter_time_window(spark, sf_dir):
    window = {"since": timedelta(minutes=1), "until": timedelta(days=3)}
    events, bases = heads_and_bases(spark, sf_dir)
    return short(filters.time_window(events, **window, bases=bases), "timestamp")


@query
def filter_time_window_untimed(spark, sf_dir):
    """No source of the documents has a timestamp, so all events stay."""
    documents = bridge.document_events(spark, sf_dir)
    kept = filters.time_window(documents, since=timedelta(minutes=1))
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("count"))


@query
def base_timestamp(spark, sf_dir):
    return ingest.base_timestamps(bridge.log_lines(spark, sf_dir), contiguous=True)


@query
def base_timestamp_stored(spark, sf_dir):
    """From the statistics of a lake."""
    path = scratch_path(spark, "lake")
    lake.write_lake(events_of(spark, sf_dir), path)
    return lake.base_timestamps(spark, path)


@query
def filter_compound(spark, sf_dir):
    events, bases = heads_and_bases(spark, sf_dir)
    return short(filters.apply_query(events, COMPOUND, PROFILE, bases), "timestamp")


@query
def important_events(spark, sf_dir):
    return short(filters.important_events(heads_of(spark, sf_dir), PROFILE))


# --- aggregations --------------------------------------------------------------


@query
def summary(spark, sf_dir):
    return commands.summarize(heads_of(spark, sf_dir), PROFILE)


@query
def summary_row(spark, sf_dir):
    return facets.summary(heads_of(spark, sf_dir))


@query
def facet_category(spark, sf_dir):
    return facets.facet(heads_of(spark, sf_dir), "category")


@query
def facet_verbosity(spark, sf_dir):
    return facets.facet(heads_of(spark, sf_dir), "verbosity", by_source=True)


@query
def facet_category_denoised(spark, sf_dir):
    return facets.facet(filters.exclude_noise(heads_of(spark, sf_dir), PROFILE), "category")


@query
def important_count(spark, sf_dir):
    return facets.important_count(heads_of(spark, sf_dir), PROFILE)


@query
def faceted_search(spark, sf_dir):
    asked = LogQuery.from_options(min_level="Error", exclude_profile_noise=True)
    found = commands.inspect(heads_of(spark, sf_dir), asked, PROFILE)
    matches = found.matches.groupBy(F.lower("category").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return found.categories.withColumn("part", F.lit("facet")).unionByName(matches.withColumn("part", F.lit("match")))


@query
def top_repeated(spark, sf_dir):
    return dedupe.top_repeated(events_of(spark, sf_dir), 20)


@query
def top_repeated_documents(spark, sf_dir):
    return dedupe.top_repeated(bridge.document_events(spark, sf_dir), 50)


@query
def suppressed_counts(spark, sf_dir):
    counts = facets.suppressed_counts(heads_of(spark, sf_dir), PROFILE)
    return counts.select("category", "suppressed", "first_timestamp", "last_timestamp", ms("duration", "duration_ms"))


@query
def log_metadata(spark, sf_dir):
    found = timing.log_metadata(heads_of(spark, sf_dir), bridge.raw_lines(spark, sf_dir))
    return found.withColumn("duration_ms", ms("duration", "duration_ms")).drop("duration")


# --- de-duplication ------------------------------------------------------------


@query
def dedupe_none(spark, sf_dir):
    return short(dedupe.deduplicate(events_of(spark, sf_dir), "none"), "count")


@query
def dedupe_exact(spark, sf_dir):
    return flat(dedupe.deduplicate(events_of(spark, sf_dir), "Exact"), "count")


@query
def dedupe_exact_documents(spark, sf_dir):
    return short(dedupe.deduplicate(bridge.document_events(spark, sf_dir), "exact"), "count")


@query
def dedupe_normalized(spark, sf_dir):
    return flat(dedupe.deduplicate(events_of(spark, sf_dir), "normalized"), "count")


@query
def dedupe_profile(spark, sf_dir):
    """Normalized de-duplication by the placeholders of a profile."""
    events = events_of(spark, sf_dir)
    return short(dedupe.deduplicate(events, "normalized", rules=PATTERNS.normalizing_rules), "count")


def _bursts(spark, sf_dir):
    events = events_of(spark, sf_dir).select(*dedupe.KEY_COLUMNS)
    return dedupe.deduplicate(events, "burst", block_rows(spark, sf_dir))


@query
def dedupe_burst(spark, sf_dir):
    return short(_bursts(spark, sf_dir), "timestamp", "count")


@query
def burst_span(spark, sf_dir):
    return short(_bursts(spark, sf_dir).filter("count > 1"), "count", ms("span", "span_ms"))


# --- order ---------------------------------------------------------------------


@query
def page(spark, sf_dir):
    matches = filters.min_level(heads_of(spark, sf_dir), "Warning")
    found = paging.page(matches, 20, 30)
    return short(found.events).withColumn("total_matches", found.total.scalar())


@query
def page_deep(spark, sf_dir):
    """A page cut by event index instead of by top-k."""
    found = paging._index_slice(heads_of(spark, sf_dir), 500, 40, block_rows(spark, sf_dir))
    return short(found)


@query
def context_window(spark, sf_dir):
    return short(paging.context_window(heads_of(spark, sf_dir), *CONTEXT))


@query
def context_multi(spark, sf_dir):
    events = heads_of(spark, sf_dir)
    anchors = events.filter(F.lower("verbosity") == "fatal")
    found = paging.context_many(events, anchors, 2, 3, block_rows(spark, sf_dir))
    return short(found, "anchor_line")


@query
def preview(spark, sf_dir):
    return paging.preview(bridge.document_events(spark, sf_dir))


@query
def time_gaps(spark, sf_dir):
    gaps = timing.time_gaps(heads_of(spark, sf_dir), timedelta(hours=1), block_rows(spark, sf_dir))
    return gaps.withColumn("gap_ms", ms("gap", "gap_ms")).drop("gap")


@query
def relative_time(spark, sf_dir):
    timed = timing.with_relative_time(*heads_and_bases(spark, sf_dir))
    return timed.select("source_id", "line_number", ms("relative_time", "relative_ms"))


# --- semantics and comparison --------------------------------------------------


@query
def semantic_match(spark, sf_dir):
    return short(semantics.match_rules(heads_of(spark, sf_dir)), *semantics.FINDING_COLUMNS)


@query
def semantic_fallback(spark, sf_dir):
    return short(semantics.fallback_findings(heads_of(spark, sf_dir)), "kind", "severity")


@query
def semantic_findings(spark, sf_dir):
    return land_findings(heads_of(spark, sf_dir)).kinds()


@query
def first_failure(spark, sf_dir):
    return land_findings(heads_of(spark, sf_dir)).first_failure()


@query
def first_failure_by_system(spark, sf_dir):
    found = land_findings(heads_of(spark, sf_dir)).first_failure_by_system()
    return found.select("source_id", "system", "line_number", "kind", "severity", "rule_id")


@query
def timeline(spark, sf_dir):
    found = land_findings(heads_of(spark, sf_dir), profile=PROFILE)
    return found.timeline(25, block_rows(spark, sf_dir))


@query
def compare_by_time(spark, sf_dir):
    return compare.align_by_time(heads_of(spark, sf_dir), LEFT, RIGHT, block_rows(spark, sf_dir))


@query
def compare_by_order(spark, sf_dir):
    return compare.align_by_order(events_of(spark, sf_dir), LEFT, RIGHT, block_rows(spark, sf_dir))


@query
def compare_divergence(spark, sf_dir):
    return compare.divergence(events_of(spark, sf_dir), LEFT, RIGHT, block_rows=block_rows(spark, sf_dir))


# --- streaming -----------------------------------------------------------------


@query
def stream_redact(spark, sf_dir):
    source, target, state = (scratch_path(spark, f"stream-{part}") for part in ("in", "out", "state"))
    sinks.write_json(events_of(spark, sf_dir), source, ordered=False)
    stream = event_stream.stream_json_events(spark, source, files_per_batch=4)
    stream = filters.min_level(redact(stream), "Warning")
    event_stream.write_json_stream(stream, target, state).awaitTermination()
    return flat(sources.read_json_events(spark, target))


@query
def stream_burst(spark, sf_dir):
    """Several files a trigger, none in order of time; open sessions come from the state."""
    source, path, checkpoint = (scratch_path(spark, f"burst-{part}") for part in ("in", "state", "checkpoint"))
    # Three triggers however large the table is; its files are more, not larger.
    files = 2 * bridge.event_files(spark, sf_dir)
    events_of(spark, sf_dir).repartition(3 * files, "line_number").write.parquet(source)
    state = BurstState(path)
    stream = event_stream.stream_parquet_events(spark, source, files_per_batch=files)
    state.start(stream, checkpoint).awaitTermination()
    return state.sessions(spark)
