"""The driver's tables seen as logs.

``events`` becomes raw log text (``raw_lines``), to be numbered, stitched and
parsed like any file. ``documents`` becomes events without timestamps
(``document_events``), one per line of text. Everything is a projection of the
table, so the work grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.ingest import ParserOptions, number_lines, parse_events
from logloom.operators.ordered import BLOCK_ROWS
from logloom.schema import DEFAULT_SCHEMA_VERSION, EVENT_COLUMNS
from logloom.sources.lines import land_lines

# Categories by event type.
CATEGORY_OF_TYPE = {
    "click": "LogOnline",
    "view": "LogSlate",
    "error": "LogNet",
    "signup": "LogInit",
    "purchase": "LogTravel",
}


# Events of a source's log file; the files of a table do not change when the table grows.
FILE_EVENTS = 4096


def file_number() -> Column:
    """Number of the log file that a line of ``raw_lines`` stands in, in order."""
    return F.expr(f"pos div {16 * FILE_EVENTS}L")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_per_block(total: int) -> int:
    """Block size for a table of ``total`` rows: about 64 blocks, within fixed bounds.

    Small tables still get several blocks, huge ones never more than
    ``BLOCK_ROWS`` rows in one. No result depends on it.
    """
    return max(512, min(BLOCK_ROWS, total // 64))


# Facts about the tables that only steer sizes, looked up once.
_ROW_COUNTS: dict[tuple[str, str], int] = {}


def _row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table, counted once; it only decides how large the blocks are."""
    key = (sf_dir, name)
    if key not in _ROW_COUNTS:
        _ROW_COUNTS[key] = table(spark, sf_dir, name).count()
    return _ROW_COUNTS[key]


def spread(df: DataFrame, name: str, sf_dir: str, key: str) -> DataFrame:
    """Give a table of few splits to all cores before its text is made.

    A small file is one split, and one task would do all the work. Tables with
    as many splits as cores stay as they are: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    place = (sf_dir, f"{name} splits")
    if place not in _ROW_COUNTS:
        _ROW_COUNTS[place] = df.rdd.getNumPartitions()
    return df.repartition(cores, key) if _ROW_COUNTS[place] < cores else df


def event_block_rows(spark: SparkSession, sf_dir: str) -> int:
    return rows_per_block(_row_count(spark, sf_dir, "events"))


def event_files(spark: SparkSession, sf_dir: str, rows: int = 1 << 18) -> int:
    """A sixth of the files that hold at most about ``rows`` events each, one at least."""
    return -(-max(1, _row_count(spark, sf_dir, "events")) // (6 * rows))


def document_block_rows(spark: SparkSession, sf_dir: str) -> int:
    # A document has about ten lines.
    return rows_per_block(10 * _row_count(spark, sf_dir, "documents"))


def _every(n: int) -> Column:
    """Every n-th event outside the polling runs."""
    return ~F.col("polling") & (F.col("event_id") % n == 0)


def _pick(column: Column, choices: list[tuple[object, Column]], otherwise: Column) -> Column:
    result = otherwise
    for value, outcome in reversed(choices):
        result = F.when(column == value, outcome).otherwise(result)
    return result


def _head_text() -> dict[str, Column]:
    value = F.col("value")
    event_id = F.col("event_id")
    number = event_id.cast("string")
    user = F.col("user_id").cast("string")
    cents = F.round(value * 100).cast("bigint").cast("string")

    category = _pick(
        F.col("event_type"), [(k, F.lit(v)) for k, v in CATEGORY_OF_TYPE.items()], F.lit("LogTemp")
    )
    category = F.when(F.col("polling"), F.lit("LogOnline")).when(
        _every(11), F.concat(F.lit("Log"), F.upper(F.substring(category, F.lit(4), F.lit(99))))
    ).otherwise(category)

    verbosity = _pick(
        F.col("event_type"),
        [
            ("error", F.when(value >= 50, "Fatal").when(value >= 15, "Error").otherwise("Warning")),
            ("view", F.when(value < 5, "Verbose").otherwise("Display")),
            ("click", F.when(value < 10, "Log").otherwise("Display")),
            ("signup", F.when(value >= 60, "Warning").otherwise("Display")),
        ],
        F.when(value < 2, "VeryVerbose").when(value >= 80, "Error").otherwise("Display"),
    )
    verbosity = F.when(F.col("polling"), F.lit("Display")).when(_every(5), F.lower(verbosity)).otherwise(verbosity)

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])

    message = _pick(
        event_id % 6,
        [
            (0, text("Session=s", user, " Ticket=t-", number, " UserId=", user, " Result=ok")),
            (
                1,
                text(
                    'JoinSession failed. Session="abc',
                    (event_id % 7).cast("string"),
                    '" Reason="timed out after ',
                    cents,
                    '"',
                ),
            ),
            (2, text("Polling session state value=", cents, ";")),
            (3, text("NetworkFailure: PendingConnectionFailure code=", (event_id % 10).cast("string"), ",")),
            (4, text("ticketId: T", number, ' userId: "u', user, '" queue=', F.col("event_type"))),
        ],
        text('a=1 a=2 =skip key= next "q=5" empty="" tail="open ', (event_id % 3).cast("string")),
    )
    message = F.when(F.col("polling"), F.lit("Polling session state")).otherwise(message)
    return {"category_text": category, "verbosity_text": verbosity, "message_text": message}


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made from ``events``: four sources, all line shapes, bursts of polling."""
    per_block = event_block_rows(spark, sf_dir)
    base = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    base = spread(base, "events", sf_dir, "event_id")
    base = base.withColumn("polling", F.expr("(event_id div 64) % 3 = 0"))
    instant = F.when(
        F.col("polling"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        + F.make_dt_interval(secs=(F.col("event_id") * 2).cast("decimal(18,6)")),
    ).otherwise(F.col("ts"))
    number = F.col("event_id").cast("string")
    stamp = F.concat(F.lit("["), F.date_format(F.col("instant"), "yyyy.MM.dd-HH.mm.ss:SSS"), F.lit("]"))
    frame = F.concat(F.lit("["), (F.col("event_id") % 1000).cast("string"), F.lit("]"))
    prefix = F.when(_every(13), F.lit("")).otherwise(F.concat(stamp, F.when(_every(29), "").otherwise(frame)))
    level = F.when(_every(19), F.lit("")).otherwise(F.concat("verbosity_text", F.lit(": ")))
    body = F.when(
        _every(31), F.concat(F.lit("Plain text line "), number, F.lit(" without category"))
    ).otherwise(F.concat("category_text", F.lit(": "), level, "message_text"))
    indent = F.when(_every(17), F.lit("  ")).otherwise(F.lit(""))
    payload = F.concat(
        F.lit('      "ticket": "t-'), number, F.lit('", "user": "u'), F.col("user_id").cast("string"), F.lit('"')
    )
    # Line 0 is the head, 1 to 3 an indented payload, 9 a blank line.
    payload_lines = F.when(~F.col("polling") & (F.col("event_type") == "error"), F.array(*map(F.lit, (1, 2, 3))))
    blank_line = F.when(_every(23), F.array(F.lit(9)))
    none = F.array().cast("array<int>")
    pieces = F.concat(F.array(F.lit(0)), F.coalesce(payload_lines, none), F.coalesce(blank_line, none))
    source = F.concat(F.lit("src"), (F.col("user_id") % 4).cast("string"))
    value = _pick(
        F.col("j"),
        [(0, F.concat(indent, prefix, body)), (1, F.lit("    {")), (2, payload), (3, F.lit("    }"))],
        F.lit("   "),
    )
    return (
        base.withColumns({"instant": instant, "source_id": source, "j": F.explode(pieces)})
        .withColumns(_head_text())
        .select(
            "source_id",
            F.concat(F.lit("log/"), "source_id", F.lit(".log")).alias("source_path"),
            F.expr(f"event_id div {per_block}L").alias("block"),
            (F.col("event_id") * 16 + F.col("j")).alias("pos"),
            value.alias("value"),
        )
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_lines`` written down like the lines of a log file."""
    return land_lines(raw_lines(spark, sf_dir))


def parsed_events(spark: SparkSession, sf_dir: str, options: ParserOptions = ParserOptions()) -> DataFrame:
    """The events parsed from ``log_lines``."""
    return parse_events(log_lines(spark, sf_dir), options, contiguous=True)


def document_lines(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    """Every line of every document, in document order inside each source.

    ``labelled`` adds the document's ``quality`` and ``toxic``, joined before
    the text is cut into lines.
    """
    per_block = max(1, document_block_rows(spark, sf_dir) // 10)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    documents = spread(documents, "documents", sf_dir, "doc_id")
    if labelled:
        labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
        documents = documents.join(labels, "doc_id", "left")
    return documents.select(
        F.col("source").alias("source_id"),
        F.concat(F.lit("doc/"), "source").alias("source_path"),
        F.expr(f"doc_id div {per_block}L").alias("block"),
        "doc_id",
        "lang",
        *(["quality", "toxic"] if labelled else []),
        F.posexplode(F.split("text", "\n")).alias("j", "value"),
    ).withColumn("pos", F.shiftleft("doc_id", 31) + F.col("j"))


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from ``documents``, without timestamps; verbosity from ``labels``."""
    lines = number_lines(document_lines(spark, sf_dir, labelled=True))
    verbosity = F.when(F.col("toxic") == 1, "Error").when(F.col("quality") == 0, "Warning").otherwise("Display")
    events = lines.select(
        F.lit(DEFAULT_SCHEMA_VERSION).alias("schema_version"),
        "source_id",
        "source_path",
        "line_number",
        F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        F.lit(None).cast("interval day to second").alias("relative_time"),
        F.lit(None).cast("int").alias("frame"),
        F.concat(F.lit("Log"), "lang").alias("category"),
        verbosity.alias("verbosity"),
        F.col("value").alias("message"),
        F.array().cast("array<string>").alias("continuation_lines"),
        F.create_map().cast("map<string,string>").alias("fields"),
        F.lit("").alias("raw_text_hash"),
    )
    return events.select(*EVENT_COLUMNS)
