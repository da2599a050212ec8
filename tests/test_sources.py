from __future__ import annotations

import numpy as np

from tremor.sources import setup_files
from tremor.streaming import monitor


def write(path, text):
    path.write_text(text)
    return str(path)


def test_setup_and_tables(spark, tmp_path):
    info = write(tmp_path / "info.txt", "Name:\nm1\nRate:\n256\nRefs:\n3 4\nDelete:\n5\nAccel:\n3 4\nVelo:\n0 1 2\nDisp:\n\ncomment\n")
    s = setup_files.setup_info(spark, info)
    assert (s.name, s.rate, s.ref, s.delete, s.quantity["velo"], s.quantity["disp"]) == ("m1", 256.0, [3, 4], [5], [0, 1, 2], [])
    dofs = write(tmp_path / "dofs.txt", "chan node az el name\n0\t\t1 0 90 a\r\n\n1 None 0.0 0\n# end\n2 3 0 0\n")
    assert [tuple(r) for r in setup_files.channel_dofs(spark, dofs).orderBy("channel").collect()] == [(0, "1", 0.0, 90.0, "a"), (1, None, 0.0, 0.0, None)]
    assert setup_files.options(spark, write(tmp_path / "o.txt", "cols:\n200\t\norder:\n40\n"), ["cols", "order"]) == {"cols": "200", "order": "40"}


def test_matrices(spark, tmp_path):
    y = np.arange(12.0).reshape(6, 2)
    np.save(tmp_path / "m.npy", y)
    a = setup_files.numpy_matrix(spark, str(tmp_path / "m.npy")).toPandas()
    b = setup_files.text_matrix(spark, write(tmp_path / "m.txt", "\n".join(f"{p} {q}" for p, q in y))).toPandas()
    for got in (a, b):
        assert np.array_equal(got.pivot(index="n", columns="channel", values="y").to_numpy(), y)


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i // 10} 00:{i % 10:02d}:00", "a" if i % 2 else "b", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "t string, channel string, y double").selectExpr("CAST(t AS timestamp) AS ts", "channel", "y")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = monitor.window_power(stream).writeStream.format("memory").queryName("power").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = ["start", "channel"]
    assert spark.table("power").orderBy(key).collect() == monitor.window_power(df).orderBy(key).collect()
