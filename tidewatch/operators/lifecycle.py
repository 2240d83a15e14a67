"""Status workflow as a fold over requested transitions, and the audit log it leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.catalog import TRANSITIONS
from tidewatch.session import kept

REASONED = "rejected"


def may_move(before: Column, after: Column) -> Column:
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return F.array_contains(allowed, F.concat(before, F.lit(">"), after))


#: Requests of one key from which on they are judged in parts.
HEAVY = 10_000


def heavy(requests: DataFrame, key: list[str]) -> bool:
    """Whether any key has HEAVY requests or more."""
    return not requests.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAVY).isEmpty()


def judge(requests: DataFrame, key: list[str], order: list[str], to: str = "to_status", start: Column | None = None, able: Column | None = None) -> DataFrame:
    """requests with from_status and accepted, those of each key applied in order from ``start`` (the same in a key's rows; 'new').

    A request counts only if the state machine allows it from the state reached so far, and ``able`` holds; others change nothing.

    The rows are dealt over parts by range of key and order, so a key of any size is spread over many. A part is read as a
    stream: one pass over it gives what its first key's requests make of each of the six states (such maps compose, so parts need no
    sight of each other) and the state of its last key; the driver chains these, two rows for each part; a second pass gives the verdicts.
    """
    first = F.lit("new") if start is None else F.coalesce(start, F.lit("new"))
    ok = F.lit(True) if able is None else F.coalesce(able, F.lit(False))
    spark = requests.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = requests.withColumns({"key__": F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), "to__": F.when(ok, F.col(to)), "start__": first})
    told = kept(told, "told")  # ranges are found by a sample: without this, what the requests come from would be computed for the sample once more
    dealt = kept(told.repartitionByRange(parts, *key, *order).withColumn("part__", F.spark_partition_id()), "judged")
    placed = dealt.repartition(parts, "part__").sortWithinPartitions("part__", *key, *order)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list] = {}  # part: first key, its first state, its map, last key, its state
        for b in batches:
            for part, k, to_, begin in zip(*(b[c].to_pylist() for c in ("part__", "key__", "to__", "start__")), strict=True):
                entry = out.setdefault(part, [k, begin, {s: s for s in STATUSES}, k, None])
                if k == entry[0]:
                    entry[2] = {s: moved(at, to_) for s, at in entry[2].items()}
                else:
                    entry[4] = moved(entry[4] if k == entry[3] else begin, to_)
                    entry[3] = k
        names = _MAPS.replace(" int", "").replace(" string", "").split(", ")
        rows = [(part, e[0], e[1], json.dumps(e[2]), e[3], e[4]) for part, e in out.items()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "part" else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    begins: dict[int, str] = {}  # what a part's first key has reached in the parts before
    carried, state = None, None
    for r in placed.select("part__", "key__", "to__", "start__").mapInArrow(maps, _MAPS).orderBy("part").collect():  # a row for each part
        begin = state if r.first_key == carried else r.first_state
        begins[r.part] = begin
        carried, state = r.last_key, json.loads(r.map).get(begin, begin) if r.last_key == r.first_key else r.last_state

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        state = ""
        for b in batches:
            before, accepted = [], []
            for part, k, to_, begin in zip(*(b[c].to_pylist() for c in ("part__", "key__", "to__", "start__")), strict=True):
                if at != (part, k):
                    state = begins[part] if at is None or at[0] != part else begin
                    at = (part, k)
                before.append(state)
                after = moved(state, to_)
                accepted.append(to_ is not None and (state, to_) in ALLOWED)
                state = after
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(accepted, pa.bool_())], names=[*b.schema.names, "from_status", "accepted"])

    schema = placed.withColumns({"from_status": F.lit("").cast("string"), "accepted": F.lit(True)}).schema
    return placed.mapInArrow(verdicts, schema).drop("key__", "to__", "start__", "part__")


ALLOWED = frozenset(TRANSITIONS)
STATUSES = tuple(dict.fromkeys(s for pair in TRANSITIONS for s in pair))
_MAPS = "part int, first_key string, first_state string, map string, last_key string, last_state string"


def moved(state: str, to: str | None) -> str:
    return to if to is not None and (state, to) in ALLOWED else state


def fold(requests: DataFrame, key: list[str], order: list[str], to: str = "to_status", reason: str | None = None, initial: str = "new", needs_reason: bool = True) -> DataFrame:
    """key, status, reason, accepted, refused, log: the requests of each key applied in order.

    A request counts only if the state machine allows it from the state reached so far (rejections also need a
    reason); refused ones change nothing. Going back to ``new`` clears the reason. Where every key has few requests, they are
    gathered as one array; else they are judged in parts. The log holds the accepted moves, and is left out where nobody reads it.
    """
    if heavy(requests, key):
        return _fold_in_parts(requests, key, order, to, reason, initial, needs_reason)
    told = F.col(reason) if reason else F.lit(None).cast("string")
    item = F.struct(*[F.col(c) for c in order], F.col(to).alias("to__"), told.alias("reason__"))
    grouped = requests.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(
        F.lit(initial).alias("status"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(0).cast("bigint").alias("accepted"),
        F.lit(0).cast("bigint").alias("refused"),
        F.expr("cast(array() as array<struct<from_status:string,to_status:string>>)").alias("log"),
    )

    def step(acc: Column, x: Column) -> Column:
        ok = F.coalesce(may_move(acc["status"], x["to__"]), F.lit(False))
        if needs_reason and reason:
            ok = ok & ((x["to__"] != REASONED) | F.coalesce(x["reason__"] != "", F.lit(False)))
        return F.struct(
            F.when(ok, x["to__"]).otherwise(acc["status"]).alias("status"),
            F.when(ok & (x["to__"] == "new"), F.lit(None).cast("string")).when(ok & (x["to__"] == REASONED), x["reason__"]).otherwise(acc["reason"]).alias("reason"),
            (acc["accepted"] + ok.cast("bigint")).alias("accepted"),
            (acc["refused"] + (~ok).cast("bigint")).alias("refused"),
            F.when(ok, F.concat(acc["log"], F.array(F.struct(acc["status"].alias("from_status"), x["to__"].alias("to_status"))))).otherwise(acc["log"]).alias("log"),
        )

    return grouped.select(*key, F.aggregate("items", start, step).alias("s")).select(*key, "s.*")


def _fold_in_parts(requests: DataFrame, key: list[str], order: list[str], to: str, reason: str | None, initial: str, needs_reason: bool) -> DataFrame:
    """The same from verdicts. Status, reason and counts are partial aggregates; only the log gathers a key's rows."""
    able = ((F.col(to) != REASONED) | F.coalesce(F.col(reason) != "", F.lit(False))) if needs_reason and reason else None
    judged = judge(requests, key, order, to, F.lit(initial), able)
    place = F.struct(*order, to)
    weighs = F.col("accepted") & F.col(to).isin(REASONED, "new")
    told = F.col(reason) if reason else F.lit(None).cast("string")
    sums = judged.groupBy(*key).agg(
        F.coalesce(F.max_by(to, F.when(F.col("accepted"), place)), F.lit(initial)).alias("status"),
        F.max_by(F.struct(F.when(F.col(to) == REASONED, told).alias("r")), F.when(weighs, place))["r"].alias("reason"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("refused"),
        F.array_sort(F.collect_list(F.when(F.col("accepted"), F.struct(place.alias("p"), F.col("from_status").alias("f"), F.col(to).alias("t"))))).alias("moves"),
    )
    return sums.withColumn("log", F.transform("moves", lambda m: F.struct(m["f"].alias("from_status"), m["t"].alias("to_status")))).drop("moves")


def steps(log: DataFrame, key: list[str], order: list[str], status: str) -> DataFrame:
    """Each entry of a verified log with the one after it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return log.withColumn("next_status", F.lead(status).over(w))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent: must be empty."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("k__")), F.col(child_key) == F.col("k__"), "left_anti")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that come more than once: must be empty."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
