"""JSON template documents (read with NULL on bad input, key layout, sink)."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerline.sources import documents as D


def test_parse_json_on_event_props(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "props")
    bad = spark.createDataFrame([(-1, '{"k": 1'), (-2, "not json")], "event_id long, props string")
    df = ev.unionByName(bad).select("event_id", D.parse_json("props").alias("doc"))
    got = df.select("event_id", F.variant_get("doc", "$.k", "int").alias("k"))
    rows = {r.event_id: r.k for r in got.collect()}
    assert rows[-1] is None and rows[-2] is None
    assert all(v is not None for k, v in rows.items() if k >= 0)


def test_template_key_and_sink(spark):
    df = spark.createDataFrame([("ACME Corp", "Box Label", '{"w": 10}')], "c string, n string, t string")
    assert df.select(D.template_key("c", "n", "app")).first()[0] == \
        "app/label-management/templates/acme_corp/box_label.json"
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerline-tpl-"), "templates")
    D.write_templates(df.select(F.col("c").alias("customer_code"),
                                F.from_json("t", "w int").alias("template")), out)
    back = spark.read.text(out).collect()
    assert [(r.value, r.customer) for r in back] == [('{"w":10}', "acme_corp")]
