import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as registered
from scopeline import oracles, registry
from scopeline.functions import fixed
from scopeline.operators import kernels

from .oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def near_edges(folder, offsets: list[int]) -> str:
    """Tables like ``SF``'s, whose one recording has a bin a day and the boxes' left edges at 100 and these offsets."""
    for name in set(TABLES) - {"events"}:
        (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    days = ", ".join(f"({k}, {v})" for k, v in enumerate(offsets))
    one = f"SELECT k::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_days(k) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, v::DOUBLE AS value, '' AS props FROM (VALUES {days}) d(k, v)"
    duckdb.sql(f"COPY ({one}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def test_a_quantile_at_a_half_rounds_as_in_sql(spark, tmp_path):
    sf = near_edges(tmp_path, [0] * 17 + [24, 29, 39])  # 0.9 of 19 steps: x2 is 324 and a tenth of 5
    compare(spark, registry.QUERIES["session_box_quantile"], registry.ORACLES["session_box_quantile"], sf)
    assert [r.x2 for r in registry.QUERIES["session_box_quantile"](spark, sf).collect()] == [324]


def test_a_quantile_of_a_segment_at_a_half_rounds_as_in_sql(spark, tmp_path):
    sf = near_edges(tmp_path, [0] * 16 + [5, 10] + [39] * 6)  # 0.1 of 7 steps: the last third's x1 is 105 and 0.7 of 5
    compare(spark, registry.QUERIES["temporal_segments_quantile"], registry.ORACLES["temporal_segments_quantile"], sf)
    assert {r.segment: r.n for r in registry.QUERIES["temporal_segments_quantile"](spark, sf).collect()}["last_third"] == 8


@pytest.mark.parametrize("name", ["temporal_segments", "temporal_segments_quantile", "temporal_segments_occupancy"])
def test_an_observation_without_a_time_is_in_the_last_segment_as_in_sql(spark, tmp_path, name):
    sf = near_edges(tmp_path, [39] + [0] * 7)
    con = duckdb.connect()
    con.sql(f"CREATE TABLE timed AS SELECT * REPLACE (CASE WHEN event_id > 0 THEN ts END AS ts) FROM '{sf}/events.parquet'")
    con.sql(f"COPY timed TO '{sf}/events.parquet' (FORMAT parquet)")
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], sf)


def test_clusters_of_close_boxes_equal_their_sql():
    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    grouped = oracles.clusters("(100 + hash(event_id) % 400)::INT", "(60 + hash(event_id + 1) % 100)::INT")
    held = {}
    for key, *row in con.sql(f"WITH RECURSIVE {grouped} SELECT recording_id, grp, x1, y1, x2, y2 FROM done JOIN f USING (recording_id, pos) ORDER BY recording_id, pos").fetchall():
        held.setdefault(key, []).append(row)
    many = set()
    for rows in held.values():
        centre = np.array([((x1 + x2) / 2 / 1280, (y1 + y2) / 2 / 720) for _, x1, y1, x2, y2 in rows])
        mine = {tuple(g) for g in map(sorted, kernels.linked(centre, fixed.TAU))}
        assert mine == {tuple(i for i, r in enumerate(rows) if r[0] == g) for g in {r[0] for r in rows}}
        many.add(len(mine))
    assert len(held) > 100 and max(many) > 4


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_the_engine_does_not_need_the_text_operators():
    code = "import sys; import scopeline.registry, scopeline.streaming.monitor; assert not [m for m in sys.modules if m.startswith('scopeline.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=registered.__file__.rpartition("/")[0])


def test_entry_imports_without_the_text_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("scopeline.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "evidence_bins" in e.queries() and not [q for q in e.queries() if q.startswith("op")] and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=registered.__file__.rpartition("/")[0])
