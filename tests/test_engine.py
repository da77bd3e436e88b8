import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidepack import cli
from tidepack.functions.dtypes import DTYPES, of_spark
from tidepack.operators import relational as R
from tidepack.operators import statistics as S
from tidepack.operators.codecs import CODECS
from tidepack.operators.segments import column_types, compress_table, decompress_table, read_segments, write_segments
from tidepack.plans.search import run_metric
from tidepack.plans.tree import Plan
from tidepack.sources import generators as G
from tidepack.sources.files import read_binary, read_csv, with_row_index, write_binary, write_csv
from tidepack.sources.header import dtypes_of, parse_header, read_header, render_header, write_header


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([3, 3, 5, 5, 5, 9, -2, rng.randint(0, 50)])) for i in range(950)]
    return R.series(spark.createDataFrame(rows, "i long, v long").repartition(5), "i", F.col("v"), 100)


def values(df, *names):
    return [tuple(r) for r in df.orderBy("row_idx").select(*names).collect()]


def test_relational_encodings_agree_with_codecs(spark, frame):
    x = np.array([v for (v,) in values(frame, "x")])
    d = DTYPES["time"]
    assert R.equal(R.delta_decode(R.delta_encode(frame)), frame)
    assert R.equal(R.scale_decode(R.scale_encode(frame)), frame)
    assert R.equal(R.rle_decode(R.rle_encode(frame)), frame)
    assert R.equal(R.dict_decode(R.dict_encode(frame), R.top_values(frame, 4)), frame)
    assert R.equal(R.unique_decode(R.unique_encode(frame), R.unique_values(frame)), frame)
    assert R.equal(R.const_decode(R.const_encode(frame)), frame)
    split = R.split(R.patch_encode(frame))
    assert R.equal(R.merge(R.patch_encode(frame), split.drop("row_idx")), frame)
    assert not R.equal(R.delta_encode(frame), frame)
    deltas = np.array([v for (v,) in values(R.delta_encode(frame), "x")])
    lows = {r.part: r.low for r in R.scale_encode(frame).collect()}
    runs = {}
    for r in R.rle_encode(frame).collect():
        runs.setdefault(r.part, []).append((r.run, r.length, r.x))
    for p in range(10):
        part = x[100 * p : 100 * (p + 1)]
        assert list(CODECS["delta"].encode(part, d).outputs[0]) == list(deltas[100 * p : 100 * (p + 1)][1:])
        assert lows[p] == part.min()
        lengths, heads = CODECS["rle"].encode(part, d).outputs
        assert [(n, v) for _, n, v in sorted(runs[p])] == list(zip(lengths, heads, strict=True))


def test_predicted_sizes_agree_with_codecs(frame):
    x = np.array([v for (v,) in values(frame, "x")])
    d = DTYPES["time"]
    for r in S.predicted_sizes(frame, 8).collect():
        part = x[100 * r.part : 100 * (r.part + 1)]
        codec = CODECS[r.encoding]
        assert (r.meta, r["size"]) == (codec.meta_size(part, d), part.nbytes if r.encoding == "none" else codec.out_size(part, d)), r


def test_statistics(frame):
    x = np.array([v for (v,) in values(frame, "x")])
    for r in S.data_statistics(frame, 8, 4).collect():
        part = x[100 * r.part : 100 * (r.part + 1)]
        assert (r["size"], r.low, r.high, r.sorted) == (len(part), part.min(), part.max(), bool((np.diff(part) >= 0).all()))
        assert r.runs == pytest.approx(run_metric(part, 4)) and r.mean == pytest.approx(part.mean())
    fake = [10_000 if i % 1000 < 2 else i % 1000 for i in range(10_000)]
    df = frame.sparkSession.createDataFrame([(v,) for v in fake], "x long")
    counts = [r.n for r in S.dense_histogram(df, 999).orderBy("bucket").collect()]
    assert len(counts) == 999 and sum(counts) == 10_000 and counts[-1] == 20


def test_stencils(spark):
    for bits in ([], [0] * 9, [1] * 17, [0, 1] * 8, [1] * 5 + [0] * 6):
        df = spark.createDataFrame([(0, i, b, i) for i, b in enumerate(bits)], "part int, row_idx long, stencil int, x long")
        assert [b for (b,) in values(R.unpack_stencil(R.pack_stencil(df)), "stencil")] == bits
        assert [v for (v,) in values(R.merge(df, R.split(df).drop("row_idx")), "x")] == list(range(len(bits)))


def test_header_round_trip(spark, tmp_path):
    schema = parse_header("a,time,0\nFiller,char,0\nFiller,float,2\n")
    assert schema.names == ["a", "Filler", "Filler_2"] and schema["Filler_2"].metadata["decimals"] == 2
    write_header(spark, schema, f"{tmp_path}/h")
    assert read_header(spark, f"{tmp_path}/h") == schema
    with pytest.raises(ValueError):
        parse_header("a,string,0")


def test_files_and_segments(spark, tmp_path):
    schema = parse_header(G.HEADER)
    df = G.generate(spark, 5000, 3)
    for padding in (0, 4):
        write_binary(df, f"{tmp_path}/bin{padding}", render_header(schema), padding)
        back = read_binary(spark, f"{tmp_path}/bin{padding}", render_header(schema), padding, split=7000)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    write_csv(df, f"{tmp_path}/csv", schema)
    lines = read_csv(spark, f"{tmp_path}/csv", schema)
    assert [r.TIME for r in lines.orderBy("row_idx").collect()] == [r.TIME for r in df.orderBy("row_idx").collect()]
    types = dtypes_of(schema)
    for mode in ("independent", "adaptive"):
        segments = compress_table(df, "row_idx", 700, mode)
        write_segments(segments, f"{tmp_path}/{mode}")
        stored = read_segments(spark, f"{tmp_path}/{mode}")
        assert stored.count() == 6 * 8
        again = decompress_table(stored, types, batch=700)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    assert stored.agg(F.sum("raw_bytes") / F.sum("enc_bytes")).first()[0] > 1.5


def test_csv_lines_are_numbered_in_file_order(spark, tmp_path):
    """Many blocks, several files in a partition, empty lines and an empty file; no sort and no shuffle of lines."""
    schema, want = parse_header("v,int,0\nw,time,0\n"), []
    for k, n in enumerate((700, 1, 0, 40, 2500)):
        rows = [(k * 10_000 + i * i % 977, i) for i in range(n)]
        (tmp_path / f"part-{k}.csv").write_text("".join(f"{v},{w}\n" + "\n" * (w % 13 == 0) for v, w in rows))
        want += [v for v, _ in rows]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("500", "3000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = read_csv(spark, str(tmp_path), schema)
            assert lines.columns == ["row_idx", "v", "w"]
            assert sorted((r.row_idx, r.v) for r in lines.collect()) == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        (tmp_path / "part-9.csv").write_text("no,1\n")
        read_csv(spark, str(tmp_path), schema).collect()


def test_row_index_is_dense(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = with_row_index(df, ["k"]).orderBy("k").collect()
    assert [r.row_idx for r in got] == list(range(1000))


def test_nulls_and_other_types_are_refused(spark):
    df = spark.createDataFrame([(0, 1), (1, None)], "i long, v long")
    with pytest.raises(Exception, match="nulls"):
        compress_table(df, "i", plan=Plan("delta")).collect()
    with pytest.raises(TypeError):
        compress_table(spark.createDataFrame([(0, "a")], "i long, v string"), "i")
    assert compress_table(df.limit(0), "i").count() == 0
    assert of_spark(df.schema["v"].dataType).name == "time"


def test_generators(spark):
    n = 4000
    df = G.rows(spark, n).select("row_idx", G.random_ints(10, 100).alias("i"), G.random_doubles().alias("d"), G.floats_of_precision(3).alias("p"), G.zigzag(100, -50, 50).alias("z"))
    rows = df.orderBy("row_idx").collect()
    assert all(10 <= r.i < 100 and 0 < r.d <= 1 for r in rows) and len({r.i for r in rows}) == 90
    assert [r.i for r in df.repartition(3).orderBy("row_idx").collect()] == [r.i for r in rows]
    assert all(abs(round(r.p, 3) - r.p) < 1e-6 for r in rows) and all(-50 <= r.z <= 50 for r in rows)
    times = [r.x for r in G.time_steps(G.rows(spark, n), 10, 0.5, batch=300).orderBy("row_idx").collect()]
    steps = np.diff(times)
    assert set(steps) == {0, 1, 2} and 0.4 < (steps == 0).mean() < 0.6
    out = [r.x for r in G.outliers(G.rows(spark, n), 0.1, 1, 0, 1000, batch=5000).orderBy("row_idx").collect()]
    assert 0.05 < np.mean([v >= 990 for v in out[:900]]) < 0.2
    stair = [r.x for r in G.rows(spark, 60).select("row_idx", G.staircase(10, 1, 0, 100).alias("x")).orderBy("row_idx").collect()]
    assert stair[0] == 100 and stair[1:10] == [1] * 9 and stair[10] == 100 and stair[11:20] == [2] * 9


def test_cli(spark, tmp_path):
    out = str(tmp_path)
    assert cli.main(["generate", "--output", f"{out}/g", "--size", "900"], spark) == 0
    assert cli.main(["compress", "--header", f"{out}/g.header", "--input", f"{out}/g", "--output", f"{out}/s", "--batch", "400", "--mode", "adaptive"], spark) == 0
    assert cli.main(["explain", "--input", f"{out}/s"], spark) == 0
    assert cli.main(["decompress", "--header", f"{out}/g.header", "--input", f"{out}/s", "--output", f"{out}/b", "--batch", "400"], spark) == 0
    a, b = (read_binary(spark, f"{out}/{d}", G.HEADER) for d in ("g", "b"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_stream(spark, tmp_path):
    from tidepack.streaming.adaptive import compress_stream, plan_history

    df = G.generate(spark, 3000, 2).select("row_idx", "TIME", "PATTERN_A_INT", "PATTERN_A_FLOAT")
    for k in range(3):
        df.filter((F.col("row_idx") >= 1000 * k) & (F.col("row_idx") < 1000 * (k + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = compress_stream(source, "row_idx", 750).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
    q.processAllAvailable()
    q.stop()
    segments = spark.read.parquet(f"{tmp_path}/out")
    assert segments.count() == 12 and plan_history(segments).count() >= 3
    back = decompress_table(segments, column_types(df, "row_idx"), batch=750)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_blobs_and_bits(spark):
    from tidepack.functions import blobs

    blobs.register(spark)
    df = spark.createDataFrame([([1.5, 2.5, 2.5, float("nan")], 1.0), ([], -0.0), (None, -2.25)], "v array<double>, f double")
    for plan in (None, "gfc", "rle(afl, none)"):
        got = df.select("v", blobs.decode_blob(blobs.encode_blob(F.col("v"), "double", plan)).alias("w")).collect()
        assert [str(r.v) for r in got] == [str(r.w) for r in got]
    bits = df.select(blobs.float_bits(F.col("f")).alias("b")).withColumn("p", blobs.bit_fields(F.col("b"))).withColumn("f", blobs.bits_float(F.col("b")))
    assert [(r.p.sign, r.p.exponent, r.p.mantissa, str(r.f)) for r in bits.collect()] == [(0, 127, 0, "1.0"), (1, 0, 0, "-0.0"), (1, 128, 1 << 20, "-2.25")]
    spark.createDataFrame([([3.0, 4.0],)], "v array<double>").createOrReplaceTempView("blobs_test")
    rows = spark.sql("select at, value from (select encode_blob(v) as b from blobs_test) t, lateral decode_segment(t.b)").collect()
    assert [(r.at, r.value) for r in rows] == [(0, 3.0), (1, 4.0)]


def test_settings(tmp_path, monkeypatch):
    from tidepack.config import Settings

    (tmp_path / "c.ini").write_text("[tidepack]\nbatch = 50\nmode = adaptive\n")
    monkeypatch.setenv("TIDEPACK_BATCH", "60")
    assert Settings.load(str(tmp_path / "c.ini")) == Settings(60, "adaptive")
    assert Settings.load(None, batch=70).batch == 70
    with pytest.raises(ValueError):
        Settings.load(None, other=1)


def test_log_goes_to_a_file_in_its_pattern(spark, tmp_path):
    import logging

    from tidepack.config import Settings

    (tmp_path / "c.ini").write_text(f"[tidepack]\nlog_level = INFO\nlog_file = {tmp_path}/t.log\nlog_bytes = 60\nlog_format = %(levelname)s %(message)s\n")
    log = logging.getLogger("tidepack.cli")
    try:
        Settings.load(str(tmp_path / "c.ini")).apply(spark)
        log.debug("unseen")
        for k in range(6):
            log.info("record %d", k)
        assert (tmp_path / "t.log").read_text().splitlines()[-1] == "INFO record 5" and (tmp_path / "t.log.1").exists()
    finally:
        Settings(log_level="ERROR").apply(spark)
    log.error("after")
    assert "after" not in (tmp_path / "t.log").read_text()


def test_concatenate_short_series(spark):
    frame = lambda *xs: spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], "part int, row_idx long, x long")
    out = R.concatenate(frame(7), frame(), frame(8, 9), frame(10))
    assert values(out, "row_idx", "x") == [(0, 7), (1, 8), (2, 9), (3, 10)]


@pytest.mark.parametrize("encode", [R.delta_encode, R.scale_encode, R.rle_encode, R.dict_encode, R.unique_encode, R.const_encode, R.patch_encode])
def test_relational_encodings_refuse_nulls(spark, encode):
    df = spark.createDataFrame([(0, 0, None), (0, 1, 3), (0, 2, 3)], "part int, row_idx long, x long")
    with pytest.raises(Exception, match="nulls"):
        encode(df).collect()


@pytest.mark.parametrize(("kind", "xs"), [("long", [2**63 - 1, -(2**63), 0, 5, -1, 2**62]), ("int", [2**31 - 1, -(2**31), 7]), ("byte", [127, -128, 3, -1]), ("double", [0.1, -0.0, 1e308, float("nan"), -1e-300, 0.3]), ("float", [1.5, -0.0, float("inf"), 2.25])])
def test_deltas_and_scales_lose_nothing(spark, kind, xs):
    df = spark.createDataFrame([(i // 3, i, x) for i, x in enumerate(xs)], f"part int, row_idx long, x {kind}")
    want = [str(x) for x in xs]
    float_kind = kind if kind in ("float", "double") else None
    assert [str(x) for (x,) in values(R.delta_decode(R.delta_encode(df), float_kind), "x")] == want
    assert [str(x) for (x,) in values(R.scale_decode(R.scale_encode(df), float_kind), "x")] == want
    d = DTYPES[{"long": "time", "byte": "char"}.get(kind, kind)]
    deltas = [x for (x,) in values(R.delta_encode(df.withColumn("part", F.lit(0))), "x")]
    assert deltas[1:] == list(CODECS["delta"].encode(np.array(xs, d.numpy), d).outputs[0])


def test_binary_files_are_replaced_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 2) for i in range(4000)], "row_idx long, a int").repartition(6)
    at = f"{tmp_path}/b"
    write_binary(df, at, "a,int,0\n")
    write_binary(df.filter("row_idx < 3"), at, "a,int,0\n")
    assert [tuple(r) for r in read_binary(spark, at, "a,int,0\n").orderBy("row_idx").collect()] == [(0, 0), (1, 2), (2, 4)]
    with open(sorted((tmp_path / "b").glob("*.bin"))[0], "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="record"):
        read_binary(spark, at, "a,int,0\n").collect()
    with pytest.raises(Exception, match="nulls"):
        write_binary(spark.createDataFrame([(0, None)], "row_idx long, a int"), at, "a,int,0\n")


def test_segments_give_whole_numbers_exactly(spark):
    from tidepack.functions import blobs

    blobs.register(spark)
    big = [2**53 + 1, -(2**62) - 1]
    spark.createDataFrame([(big,)], "v array<bigint>").select(blobs.encode_blob(F.col("v"), "time").alias("b")).createOrReplaceTempView("big_blobs")
    rows = spark.sql("select at, whole from big_blobs t, lateral decode_segment(t.b)").collect()
    assert [r.whole for r in rows] == big


def test_lanes_are_streams_of_their_own(spark):
    df = G.generate(spark, 4000, 2).select("row_idx", "TIME", "PATTERN_A_INT")
    one, many = (compress_table(df, "row_idx", 250, "adaptive", lane=n) for n in (1, 4))
    for segments in (one, many):
        back = decompress_table(segments, column_types(df, "row_idx"), batch=250)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    first = {(r.column, r.part): bytes(r.payload) for r in many.filter("part % 4 = 0").collect()}
    assert first == {(r.column, r.part): bytes(r.payload) for r in one.filter("part % 4 = 0").collect()}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_predicted_float_sizes_agree_with_codecs(spark, kind):
    rng = np.random.default_rng(6)
    d = DTYPES[kind]
    parts = [rng.random(5000), rng.normal(size=3000) * 10.0 ** rng.integers(-20, 20, 3000), np.zeros(100), np.array([-1.5]), np.round(rng.random(2049), 2)]
    parts = [p.astype(d.numpy) for p in parts]
    rows = [(k, 10_000 * k + i, float(x)) for k, p in enumerate(parts) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, f"part int, row_idx long, x {kind}")
    got = S.predicted_float_sizes(df).collect()
    assert len(got) == 2 * len(parts)
    for r in got:
        codec, x = CODECS[r.encoding], parts[r.part]
        assert (r.meta, r["size"]) == (codec.meta_size(x, d), codec.out_size(x, d)), r
