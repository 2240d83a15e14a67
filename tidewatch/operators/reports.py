"""The operational queries: daily list, pending, history, statistics, digest, reminder; and their cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.catalog import CATEGORY_LABELS, EVENT_LABELS, PRIORITY_LABELS, REGION_LABELS, STATUS_LABELS
from tidewatch.functions.urls import label

# The statuses of each list.
ACTIVE = ("new", "postponed")
PENDING = ("in_progress", "postponed")
CLOSED = ("sent_to_agent", "completed", "rejected")
RANKS = {"high": 0, "medium": 1, "low": 2}


def with_categories(signals: DataFrame, links: DataFrame) -> DataFrame:
    """signals with their categories as a sorted array, empty if none."""
    sets = links.groupBy("signal_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    return signals.join(sets, signals["id"] == sets["signal_id"], "left").drop("signal_id").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def with_history(signals: DataFrame, history: DataFrame) -> DataFrame:
    """signals with their audit log in order of time."""
    logs = history.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("changed_at", "id", "from_status", "to_status"))).alias("history"))
    return signals.join(logs, signals["id"] == logs["signal_id"], "left").drop("signal_id")


def on_day(column: Column, day: Column) -> Column:
    """Within a day, as a range that reaches the scan."""
    return (column >= day) & (column < day + F.expr("INTERVAL 1 DAY"))


def today(signals: DataFrame, day: Column) -> DataFrame:
    return signals.where(F.col("status").isin(*ACTIVE) & on_day(F.col("created_at"), day))


def pending(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("status").isin(*PENDING)).orderBy("created_at", "id")


def history(signals: DataFrame, most: int = 10) -> DataFrame:
    return signals.where(F.col("status").isin(*CLOSED)).orderBy(F.desc("updated_at"), "id").limit(most)


def stats(signals: DataFrame, now: Column) -> DataFrame:
    recent = signals.where(F.col("created_at") >= now - F.expr("INTERVAL 7 DAYS"))
    return recent.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(label(F.col("status"), STATUS_LABELS).alias("label"), "n", "status").orderBy(F.desc("n"), "status")


def rank(priority: Column, ranks: dict[str, int] | None = None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in (ranks or RANKS).items() for x in pair]), priority), F.lit(9))


def digest(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("status").isin(*ACTIVE)).orderBy(rank(F.col("priority")), "created_at", "id")


def numbered(rows: DataFrame, first: Column, moment: str = "created_at", key: str = "id") -> DataFrame:
    """rows with place, their number from 1 in the order of first, moment and key.

    Each value of first and day is sorted apart and the counts of those before are added up, so no task takes all rows.
    """
    keyed = rows.withColumn("first__", first).withColumn("day__", F.to_date(moment))
    before = keyed.groupBy("first__", "day__").agg(F.count(F.lit(1)).alias("n__"))
    sums = before.select("first__", "day__", F.coalesce(F.sum("n__").over(Window.orderBy("first__", "day__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    sums = sums.withColumnsRenamed({"first__": "of__", "day__": "on__"})
    joined = keyed.join(sums, F.col("first__").eqNullSafe(F.col("of__")) & F.col("day__").eqNullSafe(F.col("on__")))
    place = F.row_number().over(Window.partitionBy("first__", "day__").orderBy(moment, key)) + F.col("before__")
    return joined.withColumn("place", place.cast("bigint")).select(*rows.columns, "place")


def stale(signals: DataFrame, now: Column) -> DataFrame:
    return signals.where((F.col("status") == "in_progress") & (F.col("updated_at") < now - F.expr("INTERVAL 3 DAYS")))


def addressed(rows: DataFrame, recipients: list[int]) -> DataFrame:
    """Each row for each recipient; the recipients are a short configured list, so no join is needed."""
    return rows.withColumn("recipient", F.explode(F.array(*[F.lit(r).cast("bigint") for r in recipients]).cast("array<bigint>")))


def reminder(rows: DataFrame) -> Column:
    return F.concat(F.lit("⏰ Сигнал "), F.col("id").cast("string"), F.lit(" в работе больше 3 дней: "), F.coalesce("title", F.lit("None")))


def card() -> Column:
    """A signal as lines of text; lines without content are left out."""
    cats = F.array_join(F.transform("categories", lambda c: label(c, CATEGORY_LABELS)), ", ")
    title = F.when(F.coalesce("title", F.lit("")) == "", "(без названия)").otherwise(F.col("title"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("🆔 <b>"), F.col("id").cast("string"), F.lit("</b> · "), label(F.col("priority"), PRIORITY_LABELS)),
        F.concat(F.lit("<b>"), title, F.lit("</b>")),
        F.concat(F.lit("ЖС: "), F.when(F.size("categories") > 0, cats).otherwise("—")),
        F.concat(F.lit("Тип: "), label(F.col("event_type"), EVENT_LABELS, "—")),
        F.concat(F.lit("Регион: "), label(F.col("region"), REGION_LABELS, "—")),
        F.concat(F.lit("Статус: "), label(F.col("status"), STATUS_LABELS)),
        F.concat(F.lit("Дата: "), F.date_format("created_at", "dd.MM.yyyy HH:mm")),
        F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit("🔗 "), F.col("source_url"))),
    )


def messages(rows: DataFrame, recipients: list[int]) -> DataFrame:
    """What a broadcast sends, as rows: a header with the count, then a card per row by priority and age; or that there is none.

    recipient, place (0 is the header), text; the count is one aggregate, no row is collected.
    """
    counted = rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).cast("bigint").alias("place"), F.when(F.col("n") == 0, "Новых сигналов нет.").otherwise(F.concat(F.lit("📬 Утренняя сводка: "), F.col("n").cast("string"), F.lit(" сигналов"))).alias("text")
    )
    cards = numbered(rows, rank(F.col("priority"))).select("place", card().alias("text"))
    return addressed(counted.unionByName(cards), recipients).select("recipient", "place", "text")
