import os

import duckdb
import pytest
from tidepack.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLES:
        found = tables.sql(ORACLES[name])
        names = sorted(c[0] for c in found.description)
        assert sorted(df.columns) == names
        want = [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall()]
        rows = lambda rs: sorted((tuple(plain(r[n]) for n in names) for r in rs), key=str)
        assert rows(got) == rows(want)
    assert got


@pytest.fixture(scope="module")
def wide_ids(tmp_path_factory):
    """A folder of events with user ids around the ends of 16 bits, and the rows of all six column types."""
    at, ends = tmp_path_factory.mktemp("wide"), (0, 32767, 32768, 65535, 65536, 90_000)
    duckdb.sql(f"copy (select event_id, {list(ends)}[event_id % 6 + 1] as user_id, event_id * 0.25::double as value from range(2500) as r(event_id)) to '{at}/events.parquet'")
    shorts = (0, 32767, -32768, -1, 0, 24464)
    return str(at), [(i, ends[i % 6], ends[i % 6] % 100, shorts[i % 6], i, i * 0.25, i * 0.25) for i in range(2500)]


@pytest.mark.parametrize(
    "name",
    [
        "codec_afl",
        "codec_const",
        "codec_delta",
        "codec_dict",
        "codec_floattoint",
        "codec_none",
        "codec_rle",
        "codec_patchbetween",
        "codec_patch",
        "codec_gfc",
        "codec_scale",
        "codec_unique",
        "tree_10",
        "tree_1",
        "tree_11",
        "tree_12",
        "tree_2",
        "tree_3",
        "tree_4",
        "tree_5",
        "tree_6",
        "compress_adaptive",
        "compress_independent",
    ],
)
def test_user_ids_beyond_a_short_come_back(spark, wide_ids, name):
    at, want = wide_ids
    assert sorted(map(tuple, QUERIES[name](spark, at).collect())) == want


def test_segments_of_user_ids_beyond_a_short(spark, wide_ids):
    got = QUERIES["segments_adaptive"](spark, wide_ids[0]).select("column", "part", "n_rows", "raw_bytes").collect()
    rows, widths = (1000, 1000, 500), {"i": 4, "c": 1, "s": 2, "t": 8, "f": 4, "d": 8}
    assert sorted(map(tuple, got)) == sorted((c, p, n, n * w) for c, w in widths.items() for p, n in enumerate(rows))


def test_no_segment_of_the_adaptive_mode_is_larger_than_its_values(spark):
    """On sf0.1, where plans are carried from part to part."""
    at = "/root/testdata/sf0.1"
    got = sorted(map(tuple, QUERIES["segment_facts"](spark, at).collect()))
    assert got == sorted(duckdb.sql(f"with events as (from '{at}/events.parquet') {ORACLES['segment_facts']}").fetchall())
