from __future__ import annotations

import numpy as np

import __spark_entry__ as entry


def test_every_component_of_every_vector(spark, sf_dir, tmp_path):
    got = entry.queries()["panel_embeddings"](spark, sf_dir).toPandas().pivot(index="n", columns="channel", values="y").sort_index()
    want = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    assert np.allclose(got.to_numpy(), np.stack(want["embedding"]), atol=1e-6)
    vectors = [(1, [0.5] * 3), (2, [0.25] * 100), (3, []), (4, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = entry.queries()["panel_embeddings"](spark, str(tmp_path)).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in rows} == {1: 3, 2: 100}


READS_THE_WHOLE_PANEL = """panel_hourly psd_welch psd_welch_fft corr_from_psd sv_psd psd_welch_variance psd_scaling_factors psd_decibels sv_decibels power_check
block_covariances uncertain_poles uncertain_poles_of_projections corr_bt_blocks kalman_models cross_validation_lq""".split()


def test_the_last_day_counts(spark, sf_dir, tmp_path, days=31):
    """A panel of an odd number of days: events of the last day change every one of these queries."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = spark.sql(f"SELECT explode(sequence(0, 47)) AS i, timestamp '2024-01-01 00:00:00' + make_dt_interval({days - 1}) AS day").selectExpr("day + make_dt_interval(0, i div 2) AS ts", "CASE i % 2 WHEN 0 THEN 'click' ELSE 'view' END AS event_type", "1000.0D * (1 + i % 7) AS value")
    kinds = dict(events.dtypes)
    for name, factor in (("one", 1.0), ("two", 50.0)):
        more = last.selectExpr(f"CAST(ts AS {kinds['ts']}) AS ts", "event_type", f"CAST(value * {factor} AS {kinds['value']}) AS value")
        events.select("ts", "event_type", "value").unionByName(more).coalesce(1).write.parquet(str(tmp_path / name / "events.parquet"))
    queries = entry.queries()
    for name in READS_THE_WHOLE_PANEL:
        one, two = (sorted(map(str, queries[name](spark, str(tmp_path / k)).collect())) for k in ("one", "two"))
        assert one and one != two, name
