"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLES = {
    "signals": "id bigint, event_type string, priority string, status string, region string, title string, requisites string, source_url string, npa_link string, measure_id string, rejection_reason string, rejection_comment string, created_at timestamp, updated_at timestamp",
    "signal_categories": "signal_id bigint, category string",
    "status_history": "id bigint, signal_id bigint, from_status string, to_status string, changed_at timestamp, changed_by string, reason string",
    "documents_seen": "id bigint, source_key string, doc_url string, first_seen_at timestamp, signal_id bigint",
    "seen_filters": "bits bigint, bucket bigint, bitmap binary",
    "run_counters": "source_key string, ok boolean, new_signals bigint, duplicates bigint, irrelevant bigint, error string",
    "sources_state": "source_key string, last_success_at timestamp, last_seen_publication_date date",
    "progress": "source_key string, last_page int, ended boolean",
    "outbox": "signal_id bigint, measure_id string, npa_link string",
    "verdicts": "request_id bigint, user_id bigint, signal_id bigint, to_status string, at timestamp, accepted boolean, from_status string, error string",
}


def shaped(table: str, df):
    """df with exactly the table's columns; missing ones are null. A moment without a zone is an error."""
    zoneless = [n for n, kind in df.dtypes if kind == "timestamp_ntz" and f"{n} timestamp" in TABLES[table].split(", ")]
    if zoneless:
        raise ValueError(f"{table}: no zone in {', '.join(zoneless)}")
    out = []
    for part in TABLES[table].split(", "):
        name, kind = part.split(" ")
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def url_id(url: Column) -> Column:
    """A stable id: no sequence, no shared counter."""
    return F.xxhash64(url)
