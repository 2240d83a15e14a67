import datetime as dt

from pyspark.sql import functions as F

from tests.test_pipeline_parts import GOOD, LISTED, NOW, RU, item
from tidewatch.operators import ingest
from tidewatch.operators.store import Store


def step(spark, store, batch, listed, now):
    run = ingest.ingest(
        spark.createDataFrame(listed, LISTED),
        spark.createDataFrame([("tass.ru", True)], "source_key string, ok boolean"),
        store.state(),
        store.read("documents_seen").select("doc_url"),
        spark.createDataFrame([(d,) for d in RU.domains()], "domain string"),
        RU,
        F.lit(now),
    )
    store.save_run(batch, run)


def test_runs_are_idempotent_and_uncommitted_batches_unseen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("signals").count() == 0 and store.state().count() == 0
    step(spark, store, 1, [item("tass.ru", 1, 0, GOOD, "https://tass.ru/1"), item("tass.ru", 1, 1, "О погоде", "https://tass.ru/2")], NOW)
    assert (store.read("signals").count(), store.read("signal_categories").count(), store.read("status_history").count(), store.read("documents_seen").count()) == (1, 1, 1, 2)
    later = NOW + dt.timedelta(days=1)
    fresh = [item("tass.ru", 1, 0, GOOD, "https://tass.ru/1", None), item("tass.ru", 1, 1, GOOD, "https://tass.ru/3", None)]
    store.write(9, {"signals": store.read("signals")})
    (tmp_path / "commits" / "batch=9").rename(tmp_path / "gone")
    step(spark, store, 2, fresh, later)
    assert store.read("signals").count() == 2
    assert store.state().first().last_success_at == later
    assert tuple(store.totals().first()) == (2, 2)
