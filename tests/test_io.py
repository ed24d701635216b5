"""Files in and out, and the incremental stream."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.operators import recurrence, segment
from recurra.plans import descriptors
from recurra.sources import audio, images, results
from recurra.streaming.incremental import stream_features
from recurra.streaming.progress import stream_speed


def test_audio_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    for label, base in (("Normal", "n1"), ("Pathol", "p1")):
        os.makedirs(tmp_path / "raw" / label)
        y = rng.uniform(-0.9, 0.9, 5000)
        (tmp_path / "raw" / label / f"{base}.wav").write_bytes(audio.wav_bytes(y, 25000))
    (tmp_path / "raw" / "Normal" / "broken.wav").write_bytes(b"not audio")
    files = audio.list_audio(spark, str(tmp_path / "raw"))
    props = {r.filename: r for r in audio.audio_properties(files).collect()}
    assert set(props) == {"n1.wav", "p1.wav"}
    assert (props["n1.wav"].duration_s, props["n1.wav"].bit_depth_bits, props["n1.wav"].label) == (0.2, 16, "Normal")
    signal = audio.audio_signal(audio.decode_audio(files, block=1024))
    assert {r.signal_id: r["count"] for r in signal.groupBy("signal_id").count().collect()} == {"Normal_n1": 5000, "Pathol_p1": 5000}
    cut = segment.preprocess(signal, 4000, 400)
    arrays = audio.segment_arrays(cut).withColumn("label", F.split("signal_id", "_")[0])
    written = audio.write_audio(arrays, str(tmp_path / "out"), 25000).collect()
    assert len(written) == 2 and all(os.path.exists(r.path) for r in written)
    again = audio.audio_signal(audio.decode_audio(audio.list_audio(spark, str(tmp_path / "out"))))
    assert again.groupBy("signal_id").agg(F.max(F.abs("y")).alias("m")).first().m == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sample_widths(width):
    raw = {1: bytes([128, 255, 0]), 2: b"\0\0\xff\x7f\0\x80", 3: b"\0\0\0\xff\xff\x7f\0\0\x80", 4: b"\0\0\0\0\xff\xff\xff\x7f\0\0\0\x80"}
    assert audio.pcm_to_float(raw[width], width) == pytest.approx([0, 1, -1], abs=0.01)


def test_png_round_trip(spark, picture, tmp_path):
    rng = np.random.default_rng(6)
    img = rng.integers(0, 256, (40, 30))
    images.write_png(picture({"a": img}), str(tmp_path / "png")).collect()
    tiles = images.read_images(spark, str(tmp_path / "png"), size=16)
    assert tiles.count() == 6
    back = recurrence.image_rows(tiles).orderBy("r").collect()
    assert [r.s for r in back] == img.sum(axis=1).tolist()
    assert images.list_images(spark, str(tmp_path / "png")).first().filename == "a.png"
    half = images.shrink_tiles(picture({"a": np.full((8, 8), 9)}, 4), 2)
    assert recurrence.gray_counts(half).first().c == 16
    odd = np.arange(63).reshape(7, 9)
    small = images.shrink_tiles(picture({"a": odd}, 4), 2)
    assert recurrence.gray_counts(small).selectExpr("sum(c)").first()[0] == 20
    last = [r for r in small.collect() if (r.r0, r.c0) == (2, 4)][0]
    assert list(last.px)[-1] == odd[6, 8] and (last.h, last.w) == (4, 5)


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "Normal", 1.5), ("b", "Pathol", 2.5)], "filename string, label string, glcm_energy double")
    results.write_csv(df, str(tmp_path / "csv"))
    assert sorted(results.read_csv(spark, str(tmp_path / "csv")).collect()) == sorted(df.collect())
    results.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    ranked = spark.createDataFrame([(1, "x", 0.5)], "rank int, feature string, score double")
    summary = spark.createDataFrame([("A", 3)], "label string, rows int")
    doc = results.selection_document(ranked, summary).first()
    assert doc.selected_features[0].feature == "x" and doc.data_summary[0].rows == 3
    assert results.selection_report(ranked).splitlines()[2] == "| 1 | x | 0.5 |"


def test_stream_adds_only_what_is_missing(spark, tmp_path):
    rng = np.random.default_rng(12)
    source, store, log = (str(tmp_path / n) for n in ("in", "store", "log"))

    def arrive(*keys):
        rows = [(k, [float(v) for v in rng.normal(size=40)]) for k in keys]
        spark.createDataFrame(rows, "signal_id string, y array<double>").write.mode("append").parquet(source)

    def run():
        stream_features(spark, source, store, log, ("glcm", "rqa"), m=2, tau=1).awaitTermination()

    arrive("a", "b")
    run()
    arrive("b", "c")
    run()
    d = descriptors.get_descriptor("glcm")
    digest = d.hash({**d.config, "m": 2, "tau": 1})
    stored = results.read_features(spark, store, "glcm", digest)
    assert sorted(r.image_id for r in stored.collect()) == ["a", "b", "c"]
    rq = descriptors.get_descriptor("rqa")
    both = results.combine_stored(spark, store, {"glcm": digest, "rqa": rq.hash({**rq.config, "m": 2, "tau": 1})})
    assert both.count() == 3 and len(both.columns) == 17
    assert results.read_features(spark, store, "lbp", "none") is None


def test_streamed_progress(spark, tmp_path):
    rows = [(1, 0.0, 0.0), (1, 10.0, 1.0), (1, 30.0, 2.0), (1, 30.0, 3.0), (1, 5.0, 4.0)]
    schema = "signal_id long, processed double, at double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "p"))
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "p"))
    query = (
        stream_speed(events).writeStream.format("memory").queryName("speeds").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [r.speed for r in spark.table("speeds").orderBy("at").collect()] == [0.0, 10.0, 17.0, 17.0, 0.0]


def test_registry():
    assert sum(descriptors.descriptor_info(n)["count"] for n in descriptors.PUBLISHED) == 181
    assert descriptors.descriptor_info("gabor")["count"] == 180 and descriptors.descriptor_info("tamura")["count"] == 10
    with pytest.raises(ValueError):
        descriptors.get_descriptor("none")
