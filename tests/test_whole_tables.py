"""Registered queries on small tables with known answers: no row or text is left out."""

import datetime as dt

from tidewatch.plans import driver_queries

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_order_has_a_card(spark, tmp_path):
    rows = [(k, 1, "O", dt.datetime(1995, 3, 15, 10, 5), "1-URGENT") for k in range(20)]
    got = {r.id: r.card for r in driver_queries.QUERIES["q46_cards"](spark, stored(spark, tmp_path, "orders", rows, ORDERS)).collect()}
    assert sorted(got) == list(range(20))
    assert got[7] == "🆔 <b>7</b> · 🔴 Высокий\n<b>1-URGENT</b>\nЖС: ВБД\nТип: —\nРегион: zz\nСтатус: Новый\nДата: 15.03.1995 10:05"


def test_the_digest_ranks_signals_of_all_years(spark, tmp_path):
    rows = [(k, 1, "OFP"[k % 3], dt.datetime(1990 + k % 11, 1 + k % 12, 1 + k % 28, k % 24), f"{1 + k % 5}-X") for k in range(200)]
    active = sorted((k % 5 if k % 5 < 3 else 9, dt.datetime(1990 + k % 11, 1 + k % 12, 1 + k % 28, k % 24), k) for k in range(200) if k % 3 == 0)
    got = {r.id: r.place for r in driver_queries.QUERIES["q44_digest"](spark, stored(spark, tmp_path, "orders", rows, ORDERS)).collect()}
    assert got == {k: n for n, (_, _, k) in enumerate(active, 1)}


def test_text_layers_are_whole(spark, tmp_path):
    html = ["x" * 19, "x" * 20, " " * 9 + "x" * 19 + " ", "<p>" + "long " * 500 + "</p>", "", None]
    rows = [(40 + k, f"http://x/{k}", t) for k, t in enumerate(html)]
    got = {r.page_id: r.body for r in driver_queries.QUERIES["q54_text_layer"](spark, stored(spark, tmp_path, "pages", rows, "page_id long, url string, html string")).collect()}
    assert got == {40: "OCR 40", 41: "x" * 20, 42: "OCR 42", 43: html[3], 44: "OCR 44", 45: "OCR 45"}
