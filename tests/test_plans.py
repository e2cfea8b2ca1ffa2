"""Registered queries on tables with more identities than the test tables have."""

import __spark_entry__ as entry
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def write(folder, identities, dim):
    """One vector an identity and camera, near its identity's."""
    rng = np.random.default_rng(2)
    n = 6 * identities
    v = np.repeat(rng.normal(size=(identities, dim)), 6, axis=0) + 0.05 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(n), "label": np.repeat(np.arange(identities, dtype=np.int32), 6), "embedding": pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return write(tmp_path_factory.mktemp("many"), 100, 64)


@pytest.mark.parametrize("name", ["c13_c14_constrained_unions", "c11_c15_association"])
def test_unions_scale_with_the_groups(spark, sf, name):
    labels = [r.label for r in entry.queries()[name](spark, sf).collect()]
    assert len(labels) == 600 and len(set(labels)) == 100  # 500 unions


def test_exclusive_pairs_scale_with_the_groups(spark, sf):
    labels = {r.idx: r.label for r in entry.queries()["c2_camera_exclusive"](spark, sf).collect()}
    assert sum(x != -1 for x in labels.values()) > 2 * 102
    stats = entry.queries()["c3_camera_exclusive_diagnostics"](spark, sf).first()
    assert stats.coverage == pytest.approx(sum(x != -1 for x in labels.values()) / 600)


def test_selected_labels_beyond_ten_thousand_groups(spark, tmp_path):
    folder = write(tmp_path, 1700, 2)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.execute(entry.oracle_sql()["p7_selected_labels"]).fetchall()
    got = entry.queries()["p7_selected_labels"](spark, folder).collect()
    assert max(r[1] for r in want) > 10_000 and sorted(map(tuple, got)) == sorted(want)
