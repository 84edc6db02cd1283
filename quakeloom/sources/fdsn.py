"""FDSN event text (ISC): response bodies to harmonised events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.fixed_values import FDSN_ALIASES, FDSN_NULLS
from quakeloom.functions.display import response_preview
from quakeloom.functions.scalar import parse_datetime, to_float
from quakeloom.schema import conform, keep_last, stable_event_id

SNAPSHOT = (
    "struct<request:string,status_code:int,content_type:string,response_text:string,"
    "response_csv:string,response_url:string>"
)


def canonical_column(name: Column) -> Column:
    """Lower case, letters and digits only, mapped to the standard name."""
    bare = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "")
    chain = bare
    for alias, standard in FDSN_ALIASES.items():
        if alias != standard:
            chain = F.when(bare == alias, standard).otherwise(chain)
    return chain


def clean_body(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "^\\uFEFF", ""))


def body_problem(text: Column) -> Column:
    """Why a body is not a catalogue; NULL when it can be parsed or is empty.
    One with a header line is a catalogue, whatever else stands in it."""
    body = F.lower(clean_body(text))
    header = F.regexp_like(body, F.lit("(?m)^[^\\n]*eventid[^\\n]*[|,][^\\n]*$|^[^\\n]*[|,][^\\n]*eventid[^\\n]*$"))
    return (
        F.when((body == "") | header, F.lit(None).cast("string"))
        .when(body.startswith("<!doctype") | body.startswith("<html"), "html")
        .when(body.startswith("<?xml") & ~body.contains("quakeml"), "xml")
        .when(body.startswith("error") | body.contains("bad request"), "error")
        .when(body.contains("no data"), F.lit(None).cast("string"))
        .otherwise("unrecognised")
    )


def rejected_bodies(bodies: DataFrame, text: str = "response_text") -> DataFrame:
    """The bodies that `parse_bodies` leaves out, with the reason."""
    others = [c for c in bodies.columns if c != text]
    return bodies.select(*others, body_problem(F.col(text)).alias("reason")).filter("reason is not null")


def fields(line: Column, separator: Column) -> Column:
    """Values of a delimited line; a separator (a bar or a comma) inside double quotes is text."""
    bar = separator == "\\|"

    def pieces(after: str) -> Column:
        # Patterns are literals: one of a column would be compiled for every line.
        return F.when(bar, F.split(line, "\\|" + after)).otherwise(F.split(line, "," + after))

    def value(v: Column) -> Column:
        bare = F.trim(v)
        quoted = bare.rlike('^"(?s:.*)"$') & (F.length(bare) > 1)
        return F.when(quoted, F.trim(F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"')))).otherwise(bare)

    quoted = F.transform(pieces('(?=(?:[^"]*"[^"]*")*[^"]*$)'), value)
    return F.when(line.contains('"'), quoted).otherwise(F.transform(pieces(""), lambda v: F.trim(v)))


def _is_header(line: Column) -> Column:
    """A line with a delimiter that names the event id column."""
    return F.lower(line).contains("eventid") & (line.contains("|") | line.contains(","))


def parse_bodies(bodies: DataFrame, text: str = "response_text") -> DataFrame:
    """One row per data line: the input columns (without the text), line
    number and a map from standard column name to value.

    Work is per body and stays in expressions. The delimiter is the bar when
    the header has one. Trailer lines starting with '#' are dropped.
    """
    others = [c for c in bodies.columns if c != text]
    lines = F.filter(
        F.transform(F.split(clean_body(F.col(text)), "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != ""
    )
    usable = bodies.filter(body_problem(F.col(text)).isNull()).select(*others, lines.alias("_lines"))
    at = F.array_position(F.transform("_lines", _is_header), True)
    headed = usable.select(*others, "_lines", at.alias("_at")).filter("_at > 0")
    header = F.regexp_replace(F.element_at("_lines", F.col("_at").cast("int")), "^[#\\s]+", "")
    headed = headed.select(
        *others,
        "_lines",
        "_at",
        F.when(header.contains("|"), "\\|").otherwise(",").alias("_sep"),
        header.alias("_header"),
    )
    named = headed.select(
        *others, "_lines", "_at", "_sep",
        F.transform(fields(F.col("_header"), F.col("_sep")), canonical_column).alias("_names"),
    )
    # Of several headings with one meaning the first counts; told once for a body.
    first = "filter(sequence(1, size(_names)), i -> array_position(_names, element_at(_names, i)) = i)"
    rows = named.withColumn("_keep", F.expr(first)).withColumn("_keys", F.expr("transform(_keep, i -> element_at(_names, i))")).select(
        *others, "_at", "_sep", "_keep", "_keys", F.posexplode("_lines").alias("_pos", "_line")
    ).filter((F.col("_pos") >= F.col("_at")) & ~F.col("_line").startswith("#"))
    values = F.transform(fields(F.col("_line"), F.col("_sep")), lambda v: F.when(~v.isin(*FDSN_NULLS), v))
    split = rows.select(*others, "_pos", "_at", "_keep", "_keys", F.explode(F.array(values)).alias("_values"))
    record = F.map_from_arrays("_keys", F.expr("transform(_keep, i -> get(_values, i - 1))"))
    # Exploding a list of one keeps the planner from making the map again for every use of it.
    return split.select(*others, (F.col("_pos") - F.col("_at")).alias("line"), F.explode(F.array(record)).alias("record")).filter(
        F.lower(F.coalesce(F.col("record")["event_id"], F.lit(""))) != "eventid"
    )


def normalise(records: DataFrame) -> DataFrame:
    """``records``: record map, line, and optionally source_file, source_url."""
    r = F.col("record")
    columns = records.columns

    def given(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast("string")

    parsed = records.select(
        given("source_file").alias("source_file"),
        given("source_url").alias("source_url"),
        F.coalesce(r["event_id"], F.col("line").cast("string")).alias("source_event_id"),
        parse_datetime(r["time"]).alias("origin_time_utc"),
        to_float(r["latitude"]).alias("latitude"),
        to_float(r["longitude"]).alias("longitude"),
        to_float(r["depth_km"]).alias("depth_km"),
        to_float(r["magnitude"]).alias("magnitude_value"),
        r["magnitude_type"].alias("magnitude_type"),
        r["location"].alias("location_text"),
    ).filter("origin_time_utc is not null and latitude is not null and longitude is not null")

    def missing(name: str, cost: float) -> Column:
        return F.when(F.col(name).isNull(), cost).otherwise(0.0)

    quality = (
        F.lit(0.92) - missing("magnitude_value", 0.08) - missing("depth_km", 0.05)
        - missing("location_text", 0.03)
    )
    return conform(
        parsed.select(
            "*",
            stable_event_id(
                F.lit("ISC"), F.col("source_event_id"), F.col("origin_time_utc"),
                F.col("latitude"), F.col("longitude"),
            ).alias("event_id"),
            F.lit("ISC").alias("source"),
            F.col("magnitude_value").alias("magnitude_comparable"),
            F.lit("high").alias("historical_quality"),
            F.greatest(quality, F.lit(0.0)).alias("quality_score"),
            F.lit("reviewed").alias("record_status"),
            F.current_timestamp().alias("ingested_at_utc"),
        )
    )


def snapshot_bodies(snapshots: DataFrame) -> DataFrame:
    s = F.from_json("payload", SNAPSHOT)
    return snapshots.select(
        "source_file",
        s["response_url"].alias("source_url"),
        s["status_code"].alias("status_code"),
        s["content_type"].alias("content_type"),
        s["request"].alias("request"),
        F.coalesce(F.nullif(s["response_text"], F.lit("")), s["response_csv"]).alias("response_text"),
    )


def normalise_snapshots(snapshots: DataFrame) -> DataFrame:
    bodies = snapshot_bodies(snapshots).select("source_file", "source_url", "response_text")
    return normalise(parse_bodies(bodies))


def combine_chunks(events: DataFrame) -> DataFrame:
    """Union of range chunks: one row per id, the latest snapshot wins."""
    return keep_last(events, ["event_id"], ["source_file", "ingested_at_utc"])


def diagnose(snapshots: DataFrame, preview: int) -> DataFrame:
    """Size, preview of so many characters, parser verdict and parsed rows per snapshot."""
    bodies = snapshot_bodies(snapshots)
    parsed = parse_bodies(bodies.select("source_file", "response_text")).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("parsed_rows")
    )
    text = F.coalesce("response_text", F.lit(""))
    return bodies.join(parsed, "source_file", "left").select(
        "source_file", "request", "status_code", "content_type",
        F.length(text).alias("characters"),
        response_preview(text, preview).alias("preview"),
        F.coalesce("parsed_rows", F.lit(0)).alias("parsed_rows"),
        body_problem(F.col("response_text")).alias("parser_error"),
    )


def month_chunks(spark: SparkSession, start: str, end: str, months: int) -> DataFrame:
    """Half-open request ranges of ``months`` months; the last one ends at
    ``end`` or now, whichever is earlier."""
    if months < 1:
        raise ValueError("months must be at least 1")
    limits = spark.range(1).select(
        F.to_timestamp(F.lit(start)).alias("start"),
        F.least(F.to_timestamp(F.lit(end)), F.current_timestamp()).alias("end"),
    )
    first = limits.first()
    if first["start"] >= first["end"]:
        raise ValueError("the start must precede the effective end")
    return split_ranges(limits, months)


def split_ranges(ranges: DataFrame, months: int) -> DataFrame:
    """Split each (start, end) row into half-open chunks of ``months`` months.

    Each chunk starts where the one before ends, so no day is lost when a
    month is too short for the day of the start.
    """
    others = [c for c in ranges.columns if c not in ("start", "end")]
    step = f"interval {int(months)} months"
    borders = F.expr(f"""
        aggregate(sequence(0, cast(ceil(months_between(end, start) / {int(months)}) as int) + 1), array(start),
            (found, i) -> if(element_at(found, -1) < end, concat(found, array(least(element_at(found, -1) + {step}, end))), found))
    """)
    cut = ranges.filter("start < end").select(*others, borders.alias("_b"))
    chunks = cut.select(*others, "_b", F.explode(F.sequence(F.lit(1), F.size("_b") - 1)).alias("_i"))
    return chunks.select(
        *others, F.element_at("_b", F.col("_i")).alias("chunk_start"), F.element_at("_b", F.col("_i") + 1).alias("chunk_end")
    )


def chunk_progress(chunks: DataFrame, completed: DataFrame) -> DataFrame:
    """Mark ranges already held in a manifest table, so a rerun skips them."""
    return chunks.join(
        completed.select("chunk_start", "chunk_end", F.lit(True).alias("done")),
        ["chunk_start", "chunk_end"], "left",
    ).withColumn("done", F.coalesce("done", F.lit(False)))


def request_key(start: Column, end: Column, bounds: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", start, end, bounds)), 1, 16)
