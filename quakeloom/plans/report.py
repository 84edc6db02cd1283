"""Report: its tables as datasets, a Markdown view of them, and short narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.operators.magnitude import preferred_events
from quakeloom.operators.summaries import completeness_by_domain, counts_by, latest_per_group

# --- Fixed values: columns of the latest states ------------------------------
LATEST_COLUMNS = (
    "catalogue_mode", "tectonic_domain", "window_days", "window_end", "event_count",
    "comparable_event_count", "comparison_epoch_label", "comparison_magnitude_threshold",
    "maximum_magnitude", "comparable_percentile_event_rate", "comparable_reference_windows",
    "comparable_effective_sample_size", "comparable_percentile_ci_lower",
    "comparable_percentile_ci_upper",
)
TITLE = "Catálogo e estados actuais"
BOUNDARY = "Descrição estatística de dados passados: sem previsão e sem valor de aviso oficial."


def report_tables(events: DataFrame, fingerprints: DataFrame) -> dict[str, DataFrame]:
    """All tables of a report, whole, each in its order."""
    clean = preferred_events(events)
    keys = [c for c in ("catalogue_mode", "tectonic_domain", "window_days") if c in fingerprints.columns]
    return {
        "overview": clean.agg(
            F.count(F.lit(1)).alias("events"), F.min("origin_time_utc").alias("first"), F.max("origin_time_utc").alias("last")
        ),
        "sources": counts_by(clean, "source"),
        "domains": counts_by(clean, "tectonic_domain"),
        "completeness": completeness_by_domain(events).select("tectonic_domain", "event_count", "mc").orderBy("tectonic_domain"),
        "latest": latest_per_group(fingerprints, keys).select(
            [c for c in LATEST_COLUMNS if c in fingerprints.columns]
        ).orderBy(*keys),
    }


def write_report(events: DataFrame, fingerprints: DataFrame, path: str) -> None:
    """The tables as Parquet below ``path``."""
    for name, frame in report_tables(events, fingerprints).items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def markdown_table(frame: DataFrame, rows: int, headings: list[str] | None = None) -> str:
    """The first ``rows`` rows; says so if there are more. NULL is an empty cell, a bar is escaped."""

    def line(values) -> str:
        return "| " + " | ".join(values) + " |"

    def text(value) -> str:
        return "" if value is None else str(value).replace("|", "\\|")

    head = headings or frame.columns
    found = frame.limit(rows + 1).collect()
    body = [line([text(v) for v in row]) for row in found[:rows]]
    more = [f"\nOnly the first {rows} rows are shown."] if len(found) > rows else []
    return "\n".join([line(head), line(["---"] * len(head)), *body, *more])


def markdown_report(events: DataFrame, fingerprints: DataFrame, rows: int) -> str:
    """A view of the report's tables, ``rows`` rows of each."""
    tables = report_tables(events, fingerprints)
    titles = {
        "overview": ("Catálogo", ["Eventos", "Primeiro", "Último"]),
        "sources": ("Fontes", ["Fonte", "Eventos"]),
        "domains": ("Regiões", ["Região", "Eventos"]),
        "completeness": ("Completude", ["Região", "Amostra", "Mc"]),
        "latest": ("Estados mais recentes", None),
    }
    parts = [f"# {TITLE}"]
    for name, (title, headings) in titles.items():
        parts += [f"## {title}", markdown_table(tables[name], rows, headings)]
    return "\n\n".join([*parts, BOUNDARY])


def _percent(value: Column, digits: int = 1) -> Column:
    return F.when(value.isNull(), "n/d").otherwise(F.format_string(f"%.{digits}f%%", value * 100))


def _limit(value: Column) -> Column:
    return F.when(value.isNull(), "sem limiar").otherwise(F.format_string("M≥%.1f", value))


def similarity_summaries(targets: DataFrame, neighbours: DataFrame) -> DataFrame:
    """One text per query: its own state, and the first of its families."""
    best = neighbours.filter("analogue_rank = 1").select(
        "query_id", F.col("window_end").alias("best_end"), "similarity", "comparability_score"
    )
    own = F.concat(
        F.lit("Janela até "), F.date_format("window_end", "yyyy-MM-dd"), F.lit(": taxa no percentil "),
        _percent(F.col("comparable_percentile_event_rate"), 0), F.lit(" ("), _limit(F.col("comparison_magnitude_threshold")),
        F.lit(", época "), F.coalesce("comparison_epoch_label", F.lit("n/d")), F.lit("). "),
    )
    found = F.concat(
        F.lit("Família mais próxima: "), F.date_format("best_end", "yyyy-MM-dd"), F.lit("; semelhança "),
        _percent(F.col("similarity")), F.lit(", comparabilidade "), _percent(F.col("comparability_score")), F.lit("."),
    )
    return targets.join(best, "query_id", "left").select(
        "query_id",
        F.concat(own, F.when(F.col("best_end").isNull(), "Nenhuma família comparável.").otherwise(found)).alias("summary"),
    )


def replay_summaries(scores: DataFrame) -> DataFrame:
    """One text per cutoff: the three chances, what they rest on, and what came."""
    limit = _limit(F.col("threshold_magnitude"))
    return scores.select(
        "cutoff", "threshold_magnitude", "horizon_days",
        F.concat(
            F.date_format("cutoff", "yyyy-MM-dd"), F.lit(" + "), F.col("horizon_days").cast("string"), F.lit(" dias, "), limit,
            F.lit(": famílias "), _percent(F.col("analogue_probability")),
            F.lit(", frequência histórica "), _percent(F.col("historical_rate_probability")),
            F.lit(", Poisson "), _percent(F.col("poisson_probability")),
            F.lit(" (época "), F.coalesce("baseline_epoch", F.lit("n/d")), F.lit(", "),
            F.coalesce(F.col("baseline_event_count").cast("string"), F.lit("0")), F.lit(" eventos em "),
            F.format_string("%.1f", F.col("baseline_exposure_days") / 365.25), F.lit(" anos). Observado: "),
            F.when(F.col("observed_outcome"), "sim").otherwise("não"), F.lit("."),
        ).alias("summary"),
    )
