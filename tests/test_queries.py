"""Every registered query of the store against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidelog.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _rows(found, columns):
    rows = [tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in (r[c] for c in columns)) for r in found]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", [n for n in sorted(registry.oracle_sql()) if n.startswith("check_") and n != "check_healthy"])
def test_checks_find_damage(spark, name):
    """On a layout of enough files every check has something to find."""
    sf = SF.replace("0.001", "0.01")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = sorted(c.execute(registry.oracle_sql()[name]).fetchall())
    assert want and sorted(map(tuple, registry.queries()[name](spark, sf).collect())) == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert _rows((r.asDict() for r in found.collect()), sorted(columns)) == _rows(want, sorted(columns))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_rotations_fold_the_whole_log_of_each_level(spark):
    from tidelog.functions.keys import ENTRY_OVERHEAD
    from tidelog.operators import metrics

    rows = [(g, seq, "k" * (1 + seq % 3), "v" * (seq * 7 % 50)) for g in (0, 1, None) for seq in range(1, 900)]
    want = []
    for group in (0, 1, None):
        held = n = 0
        for g, _, k, v in rows:
            if g == group:
                held, n = (0, n + 1) if held >= 1000 else (held, n)
                held += len(k) + len(v) + ENTRY_OVERHEAD
        want.append(n)
    found = metrics.rotations(spark.createDataFrame(rows, "level int, seq long, key string, value string").repartition(3), 1000)
    assert sorted(x.rotations for x in found.collect()) == sorted(want)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    held = n = 0
    events = sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: r.event_id)
    for e in events:
        held, n = (0, n + 1) if held >= 4096 else (held, n)
        held += len(f"user:{e.user_id:06d}") + (0 if e.event_type == "error" else len(e.props)) + ENTRY_OVERHEAD
    assert registry.queries()["rotation_fold"](spark, SF).first()[0] == n


def test_lru_by_hand(spark):
    from collections import OrderedDict

    from pyspark.sql import functions as F
    from tidelog.operators import cache_sim

    trace = registry._accesses(spark, SF)
    placed = trace.withColumn("shard", F.pmod(F.xxhash64("file", "offset"), F.lit(cache_sim.SHARDS))).orderBy("access_id").collect()
    held, hits = [OrderedDict() for _ in range(cache_sim.SHARDS)], 0
    for r in placed:
        blocks, block = held[r.shard], (r.file, r.offset)
        hits += block in blocks
        blocks[block] = blocks.pop(block, None)
        if len(blocks) * 4096 > (4 << 20) // cache_sim.SHARDS:
            blocks.popitem(last=False)
    found = registry.queries()["lru_hit_rate"](spark, SF).first()
    assert (found.hits, found.misses) == (hits, len(placed) - hits)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
