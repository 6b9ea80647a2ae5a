import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terradelta.functions import geometry, images, text
from terradelta.operators import evaluation, masks, ranking, sampling
from terradelta.sources import tables
from terradelta.streaming import feed


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    features = [
        {"type": "Feature", "properties": {"id": 1, "name": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"id": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"type": "Feature", "properties": {"id": 3}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = tables.geojson(spark, str(tmp_path / "x.geojson"), "id long, name string").orderBy("id").select("id", F.size("geometry").alias("n")).collect()
    assert [(r.id, r.n) for r in rows] == [(1, 1), (2, 2), (3, None)]


def test_csv_and_layers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,wkt,ok\n0002,"POLYGON ((0 0, 1 0, 1 1, 0 0))",True\n')
    df = tables.csv(spark, str(tmp_path / "a.csv"), "id int, wkt string, ok boolean")
    assert df.first().asDict() == {"id": 2, "wkt": "POLYGON ((0 0, 1 0, 1 1, 0 0))", "ok": True}
    assert tables.optional_csv(spark, str(tmp_path / "none.csv"), "id int") is None
    out = str(tmp_path / "layers")
    assert tables.write_layers(out, {"one": df, "empty": df.limit(0), "two": df}) == ["one", "two"]
    assert tables.layer(spark, out, "two").count() == 1 and tables.layer(spark, out, "absent").count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        tables.require_columns(df, {"nothing"})
    assert tables.with_optional(df, "extra", "double").schema["extra"].dataType.simpleString() == "double"


def test_samples(spark):
    df = spark.range(100).withColumn("s", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    assert sampling.sample(df, "id", 7).count() == 7 and sampling.sample(df, "id", 700).count() == 100
    assert sampling.sample(df, "id", 7).collect() == sampling.sample(df, "id", 7).collect()
    got = {r.s: r["count"] for r in sampling.stratified(df, "s", "id", {"a": 5}).groupBy("s").count().collect()}
    assert got == {"a": 5, "b": 33, None: 33}


def test_zero_denominators(spark):
    df = spark.createDataFrame([(False, False)], "p boolean, a boolean")
    r = evaluation.binary_measures(df, F.col("p"), F.col("a")).first()
    assert r.precision is None and r.recall is None and r.f1 is None and r.accuracy == 1
    zero = F.lit(0.0)
    assert spark.range(1).select(*evaluation.segmentation_measures(zero, zero, zero).values()).first() == (0.0, 0.0, 0.0, 0.0)


def test_ranking_falls_back(spark):
    df = spark.createDataFrame([(1, 0, 0.2, 0.9, True), (1, 1, 0.9, 0.9, True), (2, 0, 0.3, 0.0, False), (2, 1, 0.4, 0.0, False)], "id int, i int, raw double, w double, ok boolean")
    got = {r.id: (r.i, r.combined, r.reranked) for r in ranking.best_candidate(df, "id", "i", F.col("w"), F.col("ok"), F.col("raw")).collect()}
    assert got == {1: (0, 0.9, True), 2: (1, 0.4, False)}


def test_images(spark):
    df = spark.createDataFrame([(bytearray([0, 10, 20, 30]), 2, 4), (bytearray([7] * 6), 3, 3), (None, 2, 2), (bytearray(), 2, 2)], "g binary, w int, n int")
    rows = df.select(images.class_mask(F.col("g"), F.col("w"), F.lit(20)).alias("c"), images.resized(F.col("g"), F.col("w"), F.col("n")).alias("z"), images.gamma_corrected(F.col("g"), F.lit(1.0)).alias("same"), images.gamma_corrected(F.col("g"), F.col("w") / 2).alias("dark")).collect()
    assert [[tuple(x) for x in r.c] if r.c is not None else None for r in rows] == [[(1, 0, 0)], [], None, []]
    assert list(rows[0].z)[:4] == [0, 2, 8, 10] and len(rows[0].z) == 16 and list(rows[1].z) == [7] * 9 and rows[2].z is None and not rows[3].z
    assert list(rows[0].same) == [0, 10, 20, 30] and list(rows[1].dark) == [int((7 / 255) ** 1.5 * 255)] * 6


def test_model_hook(spark):
    """Each task makes its model once and gives out rows of another shape."""

    def model():
        calls = []

        def infer(batch):
            calls.append(1)
            return batch.assign(score=batch["id"] * 0.5, call=len(calls))[["id", "score", "call"]]

        return infer

    got = masks.predict(spark.range(50, numPartitions=2), model, "id long, score double, call int").collect()
    assert sorted((r.id, r.score) for r in got) == [(i, i / 2) for i in range(50)]


def test_file_names_of_long_ids(spark):
    ids = spark.createDataFrame([(7,), (12345,), (999,)], "id long")
    listing = spark.createDataFrame([("tight/12345.png",), ("wide/0007.png",), ("tight/0007.png",), ("tight/1234.png",)], "path string")
    assert sorted(tuple(r) for r in tables.in_first_folder(ids, listing, ["tight", "wide"]).collect()) == [(7, "tight/0007.png"), (12345, "tight/12345.png")]
    assert spark.range(1).select(text.zero_padded(F.lit(1234567), 6), text.zero_padded(F.lit(5), 4)).first() == ("1234567", "0005")


def test_scratch_goes(spark):
    from pathlib import Path

    with tables.scratch(spark) as path:
        folder = Path(path.removeprefix("file://"))
        assert tables.written(spark.range(5)).count() == 5 and len(list(folder.glob("written-*"))) == 1
        assert tables.shared_folder(spark) == path
    assert not folder.exists() and folder.parent.exists() and tables.shared_folder(spark) != path


def test_preprocessing_by_config(spark):
    df = spark.createDataFrame([(bytearray([0, 100, 255]),)], "g binary")
    r = df.select(images.preprocessed(F.col("g"), {"mode": "gamma", "gamma": 2}).alias("d"), images.preprocessed(F.col("g"), {"mode": "none"}).alias("s"), images.colour_mask(F.col("g"), F.lit(1), (0, 100, 255)).alias("m")).first()
    assert list(r.d) == [0, 39, 255] and list(r.s) == [0, 100, 255] and [tuple(x) for x in r.m] == [(0, 0, 0)]
    with pytest.raises(ValueError, match="no such preprocessing"):
        images.preprocessed(F.col("g"), {"mode": "clahe"})


def test_quantiles_of_large_groups(spark):
    """Against a sort, with ties, groups of one, nulls and more tasks than groups."""
    import random

    r = random.Random(2)
    rows = [(k, r.choice([None, float(r.randrange(50)), r.random()])) for k in [None, 1, 1, 1, 1, 2, 3] for _ in range(200)] + [(7, 5.0), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {x.k: tuple(x)[1:] for x in evaluation.describe(df, ["k"], "v").collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        at = lambda q: (lambda p: values[int(p)] + (values[min(int(p) + 1, len(values) - 1)] - values[int(p)]) * (p - int(p)))((len(values) - 1) * q)  # noqa: B023, E731
        assert got[key][0] == len(values)
        assert (got[key][4], got[key][5], got[key][6]) == (pytest.approx((at(0.25), at(0.5), at(0.75))) if values else (None, None, None))


def test_as_of(spark):
    states = spark.createDataFrame([(1, "a", 1, "2020-01-01"), (1, "b", 2, "2020-02-01"), (1, "c", 3, "2020-03-01"), (2, "d", 4, "2020-03-01"), (3, None, 5, "2020-01-01"), (3, "e", 6, "2020-01-01")], "id int, state string, key int, day string").select("id", "state", "key", F.to_date("day").alias("snapshot_date"))
    df = tables.snapshots(spark, tables.write_snapshots(states))
    found = tables.as_of(df, "id", "key", "2020-02-15")
    assert sorted((r.id, r.state) for r in found.collect()) == [(1, "b"), (3, "e")]
    assert "PartitionFilters: [isnotnull(snapshot_date" in found._jdf.queryExecution().toString()


def test_stream_of_decisions(spark, tmp_path):
    schema = "pred boolean, iou double, area_diff double, shift double"
    spark.createDataFrame([(True, 0.9, 0.0, 1.0), (True, 0.1, 0.0, 1.0)], schema).write.parquet(str(tmp_path / "in"))
    q = feed.decisions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("decided").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.decision for r in spark.table("decided").collect()) == ["flag_review", "keep"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").withColumn("geometry", geometry.box(F.col("id"), F.lit(0), F.col("id") + 2, F.lit(1)))
    tables.write_geojson(df, str(tmp_path / "g"))
    lines = sorted(x for f in (tmp_path / "g").glob("part-*") for x in f.read_text().splitlines())
    first = json.loads(lines[0])
    assert len(lines) == 2 and first["properties"] == {"id": 1, "name": "a"} and first["geometry"]["coordinates"][0][0][1] == [3.0, 0.0]
    tables.write_csv(df, str(tmp_path / "c"))
    tables.write_csv(df, str(tmp_path / "w"), keep_wkt=True)
    assert tables.csv(spark, str(tmp_path / "c"), "id long, name string").count() == 2
    again = tables.csv(spark, str(tmp_path / "w"), "id long, name string, geometry string").orderBy("id").first()
    assert again.geometry == "POLYGON ((1.0 0.0, 3.0 0.0, 3.0 1.0, 1.0 1.0, 1.0 0.0))"
    tables.write_with_config(df.drop("geometry"), str(tmp_path / "k"), {"seed": 4})
    assert spark.read.parquet(str(tmp_path / "k/rows")).count() == 2 and json.loads(spark.read.text(str(tmp_path / "k/config")).first()[0]) == {"seed": 4}
    (tmp_path / "s.json").write_text('{"iou": 0.5}')
    assert tables.config(str(tmp_path / "s.json")) == {"iou": 0.5}


def test_plan_or_config(spark, tmp_path):
    rows = [(4, "[]"), (5, "[[1,2]]")]
    assert tables.csv_or_rows(spark, str(tmp_path / "none.csv"), "id int, points string", rows).count() == 2
    (tmp_path / "plan.csv").write_text("id,points\n0007,[]\n")
    assert [r.id for r in tables.csv_or_rows(spark, str(tmp_path / "plan.csv"), "id int, points string", rows).collect()] == [7]


def test_small_functions(spark):
    r = spark.range(1).select(geometry.area_diff_frac(F.lit(3.0), F.lit(2.0)).alias("d"), geometry.area_diff_frac(F.lit(3.0), F.lit(0.0), 1.0).alias("z"), geometry.centre_box(100, 50, 0.5).alias("b"), text.top_folder(F.lit("a/b.png")).alias("t"), text.top_folder(F.lit("b.png")).alias("n"), text.after_token(F.lit("x/old/y/old/z"), ["/new/", "/old/"]).alias("a"), text.normal_id(F.lit("12.00")).alias("i")).first()
    assert (r.d, r.z, tuple(r.b), r.t, r.n, r.a, r.i) == (0.5, 1.0, (25.0, 12.5, 75.0, 37.5), "a", None, "y/old/z", 12)
    df = spark.createDataFrame([(1, "x")], "id long, v string")
    assert evaluation.one_row(df, "id", 1) == {"id": 1, "v": "x"}
    with pytest.raises(KeyError):
        evaluation.one_row(df, "id", 2)


def test_ordinals_of_many_tasks(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k")).repartition(7)
    assert [tuple(r) for r in sampling.ordinals(df, ["k"], "n").orderBy("k").collect()] == [(i, i) for i in range(5000)]
    assert sampling.ordinals(df.limit(0), ["k"], "n").count() == 0


def test_ordinals_of_sampled_ranges(spark):
    """More rows than the range sample takes, and a filter on a column that only the numbered rows carry."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 200_000, 1, 4).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
        kept = sampling.ordinals(df, ["k"], "n").where("v > 25").select("k", "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(kept) == df.where("v > 25").count() and all(r.k == r.n for r in kept)


def test_rows_are_dealt_to_all_cores(spark):
    assert tables.dealt(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_resizing_takes_blocks_of_images():
    side = np.where(np.arange(300) % 2 == 0, 32, 128)
    chips = [bytes((x * x + 3 * y + k) % 256 for y in range(64) for x in range(64)) for k in range(3)] * 100
    chips[7] = None
    width = np.full(300, 64)
    tracemalloc.start()
    made = images.square_bytes(pa.array(chips, pa.binary()), width, side)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 250e6
    alone = [images.square_bytes(pa.array([c], pa.binary()), width[:1], side[k : k + 1])[0] for k, c in enumerate(chips)]
    assert made.to_pylist() == [a.as_py() for a in alone]
    assert len(images.square_bytes(pa.array([], pa.binary()), width[:0], side[:0])) == 0
