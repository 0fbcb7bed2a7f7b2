"""Every registered query runs; where SQL can express it, its rows are those of the SQL."""

import json
import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitreon import registry


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (np.ndarray, list)):
            return tuple(one(x) for x in v)
        v = v.item() if hasattr(v, "item") else v
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, sql, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        want = sql.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_rings_to_24(spark, sf, monkeypatch):
    """The queries find a ring of 20 formers, were a structure to have one."""
    from vitreon.operators import graph
    from vitreon.plans import structures

    name = structures.atoms(spark, sf).first().structure_id
    ring = spark.createDataFrame([(name, 0, *sorted((i, (i + 1) % 20))) for i in range(20)], "structure_id string, frame int, u long, v long")
    monkeypatch.setattr(graph, "former_edges", lambda *_: ring)
    assert structures.rings(spark, sf).collect() == [(name, 20, 1)]
    assert json.loads(structures.analysis(spark, sf).where(F.col("structure_id") == name).first().rings) == {"20": 1}


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLES) <= set(e.oracle_sql())


def test_dump_frames_below_a_folder_named_run(spark, sf, sql, tmp_path, monkeypatch):
    from vitreon.plans import structures

    monkeypatch.setattr(structures, "folder", lambda *_: str(tmp_path / "run" / "a-run"))
    assert rows(structures.dump_frames(spark, sf).toPandas()) == rows(sql.execute(structures.DUMP_FRAMES).df())


def test_settled_at_just_the_criterion(spark, tmp_path):
    """Two results 24 apart have an error of 12, which rounding puts on the side where SQL puts it; the table may be a folder."""
    from vitreon.plans import ledger

    a = [k * 3 + k * k % 97 / 100 for k in range(200)]
    at = pd.date_range("2024-01-01", periods=400, freq="s").astype("datetime64[us]")
    df = pd.DataFrame({"event_id": range(400), "ts": at, "user_id": [k // 2 for k in range(400)], "event_type": "view", "value": [round(x + d, 2) for x in a for d in (0, 24)], "props": "{}"})
    (tmp_path / "events.parquet").mkdir()
    for i in range(2):
        df.iloc[i::2].to_parquet(tmp_path / "events.parquet" / f"part-{i}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(ledger.stream_settled(spark, str(tmp_path)).toPandas()) == rows(con.execute(ledger.STREAM_SETTLED).df())
