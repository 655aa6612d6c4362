"""The store against dict models: state, scans, merges, compaction, files, filters, caches, logs, streams."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tidelog import cli
from tidelog.functions import bloom
from tidelog.functions.keys import BadPattern, CommandError, KeyTooLarge, check_key, glob_to_regex, shared_prefix
from tidelog.operators import cache_sim, check, compact, layout, metrics, ranks, scan, state, workload
from tidelog.operators.merge import merge, ordered
from tidelog.plans import registry
from tidelog.sources import edits as edit_log
from tidelog.sources import log as logs
from tidelog.sources import wal
from tidelog.store import Session, Store
from tidelog.streaming import lww

ROW = "key string, seq long, tombstone boolean, value string"


def make(spark, rows, more=""):
    return spark.createDataFrame(rows, ROW + more)


def seeded(n, keys, seed, share):
    r = random.Random(seed)
    return [(f"key-{r.randrange(keys):04d}", s + 1, dead := r.random() < share, None if dead else f"v{s}") for s in range(n)]


def model(rows):
    out = {}
    for key, seq, dead, value in sorted(rows, key=lambda x: x[1]):
        out[key] = None if dead else value
    return {k: v for k, v in out.items() if v is not None}


def test_live_state_equals_dict(spark):
    rows = seeded(3000, 300, 42, 0.2)
    assert {r.key: r.value for r in state.live(make(spark, rows)).collect()} == model(rows)


def test_every_flush_interleaving(spark):
    """All 128 ways to cut seven versions of a key into files give the same newest version."""
    rows = [(f"{mask}", s + 1, s == 6, None if s == 6 else f"v{s}", bin(mask & ((1 << s) - 1)).count("1")) for mask in range(128) for s in range(7)]
    log = make(spark, rows, ", file_number int")
    assert state.live(log).count() == 0
    alive = state.live(log.where("not tombstone")).collect()
    assert len(alive) == 128 and {r.value for r in alive} == {"v5"}


def test_ten_source_merge(spark):
    rows = [(*r, k % 10) for k, r in enumerate(seeded(4000, 250, 7, 1 / 3))]
    sources = [make(spark, [r[:4] for r in rows if r[4] == k]) for k in range(10)]
    got = ordered(merge(sources, False)).collect()
    assert {r.key: r.value for r in got} == model([r[:4] for r in rows])
    assert [r.key for r in got] == sorted(r.key for r in got)
    assert merge(sources, True).count() == len({r[0] for r in rows})


def test_early_drop_resurrects(spark):
    log = make(spark, [("k", 1, False, "old"), ("k", 2, True, None)])
    assert state.early_drop(log).count() == 1 and state.live(log).count() == 0


def test_edge_keys_and_empty_values(spark):
    log = make(spark, [("", 1, False, "x"), ("e", 2, False, ""), ("k" * 65_536, 3, False, "y")])
    assert state.get(log, "").first().value == "x"
    assert state.get(log, "e").first().value == ""
    check_key("k" * 65_536)
    with pytest.raises(KeyTooLarge):
        check_key("k" * 65_537)


def test_binary_keys_order_as_bytes(spark):
    rows = [(bytes(k), n, False, b"") for n, k in enumerate([[255], [128], [127], [1], [0, 1], [0], []])]
    log = spark.createDataFrame(rows, "key binary, seq long, tombstone boolean, value binary")
    keys = [bytes(r.key) for r in scan.page(log).collect()]
    assert keys == sorted(keys)


def test_delete_effects_and_appends(spark):
    log = make(spark, [("a", 1, False, "1"), ("b", 2, False, "2")])
    log = state.delete(log, spark.createDataFrame([("a",), ("z",)], "key string"))
    log = state.delete(log, spark.createDataFrame([("a",)], "key string"))
    assert state.delete_effects(log).first() == (3, 1)
    assert state.dbsize(state.put(log, spark.createDataFrame([("q", "5")], "key string, value string"))).first().n == 2


def test_scan_walk_and_pages(spark):
    log = make(spark, [(f"k{n:02d}", n + 1, False, "v") for n in range(20)] + [(f"k{n:02d}", n + 100, True, None) for n in range(0, 20, 2)])
    keys, cursor = [], None
    while True:
        page = scan.read_page(log, cursor, 5)
        keys += page.keys
        if page.cursor is None:
            break
        cursor = page.cursor
    assert keys == [f"k{n:02d}" for n in range(1, 20, 2)]
    walked = scan.walk(log, 5).orderBy("key").collect()
    assert [(r.page_no, r.key) for r in walked] == [(k // 5, key) for k, key in enumerate(keys)]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("user:*", ["user:1", "user:"], ["post:1", "user:1/2"]),
        ("a?c", ["abc"], ["ac", "a/c"]),
        ("[a-c]x", ["ax", "cx"], ["dx"]),
        ("[^a]x", ["bx"], ["ax"]),
        ("a\\*b", ["a*b"], ["axb"]),
        ("a.c", ["a.c"], ["abc"]),
        ("[]a]", None, None),
        ("[a", None, None),
        ("a\\", None, None),
    ],
)
def test_globs(spark, pattern, yes, no):
    if yes is None:
        with pytest.raises(BadPattern):
            glob_to_regex(pattern)
        return
    df = spark.createDataFrame([(k,) for k in yes + no], "k string").where(F.col("k").rlike(glob_to_regex(pattern)))
    assert sorted(r.k for r in df.collect()) == sorted(yes)


def test_ranked_equals_row_number(spark):
    rows = spark.createDataFrame([(f"{random.Random(n).random():.6f}",) for n in range(500)], "k string")
    got = {r.k: r.n for r in ranks.ranked(rows, "k", "n").collect()}
    assert got == {k: n + 1 for n, k in enumerate(sorted(got))}


def test_candidates(spark):
    files = spark.createDataFrame([(0, 1, "a", "m"), (0, 2, "c", "z"), (1, 3, "b", "b")], "level int, file_number long, smallest string, largest string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), ("zz",)], "key string")
    got = {(r.key, r.file_number) for r in layout.candidates(keys, files).collect()}
    assert got == {("a", 1), ("b", 1), ("b", 3), ("c", 1), ("c", 2), ("z", 2)}


def test_edits(spark):
    rows = [(1, 0, "ADD", 0, 7), (2, 0, "DELETE", 0, 7), (3, 0, "DELETE", 0, 8), (4, 0, "DELETE", 0, 9), (4, 1, "ADD", 0, 9)]
    e = spark.createDataFrame(rows, "edit_id long, ordinal int, kind string, level int, file_number long")
    for c in ("size", "smallest_seq", "largest_seq", "counter_value"):
        e = e.withColumn(c, F.lit(None).cast("long"))
    e = e.withColumn("smallest", F.lit("a")).withColumn("largest", F.lit("b"))
    assert [r.file_number for r in layout.replay(e).collect()] == [9]
    assert {(r.edit_id, r.file_number) for r in layout.bad_deletes(e).collect()} == {(3, 8), (4, 9)}


def test_settle_reaches_the_live_state(spark):
    rows = seeded(1500, 120, 3, 0.3)
    log = make(spark, rows).withColumn("file_number", F.floor(F.col("seq") / 200).cast("long")).withColumn("level", F.lit(0))
    options = compact.Options(base_bytes=1000, output_bytes=500)
    done = compact.settle(log, options)
    assert {r.key: r.value for r in state.live(done).collect()} == model(rows)
    files = layout.file_metadata(done)
    assert check.report(files, done, files.select("file_number", "size"), 1500).count() == 0
    assert compact.worst_level(files, options).isEmpty()


def test_grow_base_stops_at_the_first_that_fails(spark):
    rows = [(1, n, 10, f"{c}0", f"{c}9") for n, c in enumerate("abcd", 1)] + [(2, 9, 10, "c5", "c6")]
    files = spark.createDataFrame(rows, "level int, file_number long, size long, smallest string, largest string")
    base = files.where("file_number = 1")
    grown = compact.grow_base(files, base, compact.parents(files, base, 1), 1)
    assert sorted(r.file_number for r in grown.collect()) == [1, 2]


def test_roll(spark):
    keys = spark.createDataFrame([(0, f"k{n}", 10) for n in range(7)], "range int, key string, size long")
    assert [r.file for r in compact.roll(keys, 25).orderBy("key").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_bloom_rate(spark):
    keys = spark.range(5000).select(F.lit(1).cast("long").alias("file_number"), F.concat(F.lit("present:"), "id").alias("key"))
    absent = spark.range(20000).select(F.concat(F.lit("absent:"), "id").alias("key"), F.lit(1).cast("long").alias("file_number"))
    filters = bloom.build(keys)
    assert bloom.probe(filters, keys).count() == 5000
    assert 0.003 < bloom.probe(filters, absent).count() / 20000 < 0.015


def test_lru(spark):
    rows = [(0, 1, 0, 10), (1, 1, 0, 10), (2, 1, None, 0), (3, 1, 0, 10), (4, 2, 0, 999)]
    trace = spark.createDataFrame(rows, "access_id long, file long, offset long, size long")
    got = {r.access_id: r.hit for r in cache_sim.lru_replay(trace, 100, shards=1).collect()}
    assert got == {0: False, 1: True, 3: False, 4: False}
    assert metrics.hit_rate(cache_sim.lru_replay(trace, 100, shards=1)).first().hit_rate == 0.25


def test_workload_reads_equal_a_dict(spark):
    ops = workload.generate(spark, 2000, 64, workload.MIXES["commit"])
    now, want = {}, {}
    for r in ops.orderBy("op_id").collect():
        if r.kind == "PUT":
            now[r.key] = r.value
        elif r.kind == "DEL":
            now.pop(r.key, None)
        elif r.kind == "GET":
            want[r.op_id] = now.get(r.key)
    answers = workload.replay_reads(ops)
    assert {r.op_id: r.value for r in answers.collect()} == want
    assert workload.first_divergence(answers, answers).isEmpty()
    broken = answers.withColumn("value", F.when(F.col("op_id") == min(want), "x").otherwise(F.col("value")))
    assert workload.first_divergence(answers, broken).first().op_id == min(want)
    for d in ("zipf", "sequential", "prefix"):
        assert workload.generate(spark, 100, 16, workload.MIXES["stress"], d).select("key").distinct().count() <= 16


def test_shrink():
    assert workload.shrink(list(range(100)), lambda ops: 13 in ops and 77 in ops) == [13, 77]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=70_000), max_size=4))
def test_wal_round_trip(records):
    assert list(wal.records(wal.frame(records))) == records


def test_wal_truncated_anywhere_or_damaged():
    records = [wal.encode_batch(k, [(wal.SET, b"k%d" % k, b"v" * 30), (wal.DELETE, b"d", None)]) for k in (1, 3, 5)]
    data = wal.frame(records)
    for n in range(len(data)):
        assert list(wal.records(data[:n])) == records[: n * 3 // len(data)]
    broken = bytearray(data)
    broken[10] ^= 1
    with pytest.raises(wal.Corruption):
        list(wal.records(bytes(broken)))
    assert wal.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(wal.Corruption):
        wal.decode_batch(records[0] + b"x")


def test_wal_source_and_parquet_log(spark, tmp_path):
    (tmp_path / "000001.wal").write_bytes(wal.frame([wal.encode_batch(1, [(wal.SET, b"a", b"1"), (wal.SET, b"b", b"")])]))
    (tmp_path / "000002.wal").write_bytes(wal.frame([wal.encode_batch(3, [(wal.DELETE, b"a", None)])])[:-1])
    (tmp_path / "000003.wal").write_bytes(wal.frame([wal.encode_batch(4, [(wal.SET, b"c", b"3")])]))
    with pytest.raises(Exception, match="damage"):
        wal.read(spark, str(tmp_path)).collect()
    (tmp_path / "000003.wal").unlink()
    log = wal.read(spark, str(tmp_path))
    assert sorted((bytes(r.key), r.seq) for r in log.collect()) == [(b"a", 1), (b"b", 2)]
    logs.append(log, f"{tmp_path}/log")
    assert logs.highest_sequence(logs.read(spark, f"{tmp_path}/log")) == 2
    logs.write_sorted(log, f"{tmp_path}/sst", 2)
    assert logs.read_sorted(spark, f"{tmp_path}/sst").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = seeded(600, 50, 5, 0.3)
    random.Random(1).shuffle(rows)
    for k in range(3):
        logs.append(make(spark, rows[k::3]).coalesce(1), f"{tmp_path}/log")
    lww.start_state(logs.stream(spark, f"{tmp_path}/log", binary=False), "lww", f"{tmp_path}/c1").awaitTermination()
    assert {r.key: r.value for r in spark.table("lww").where("not tombstone").collect()} == model(rows)
    lww.start_flush(logs.stream(spark, f"{tmp_path}/log", binary=False), f"{tmp_path}/l0", f"{tmp_path}/c2").awaitTermination()
    flushed = spark.read.parquet(f"{tmp_path}/l0")
    assert flushed.select("file_number").distinct().count() == 3
    assert {r.key: r.value for r in state.live(flushed.select("key", "seq", "tombstone", "value")).collect()} == model(rows)


def test_commands(spark):
    s = Session(Store(spark))
    assert s.run("PING") == "PONG" and s.run("ping hi") == "hi" and s.run("ECHO x") == "x"
    for k in range(5):
        assert s.run(f"SET key{k} v{k}") == "OK"
    assert s.run("GET key1") == "v1" and s.run("GET nope") is None
    assert s.run("EXISTS key1 key1 nope") == 2
    assert s.run("DEL key1 key1 nope") == 1
    assert s.run("DBSIZE") == 4
    token, keys = s.run("SCAN 0 COUNT 2")
    more = s.run(f"SCAN {token} count 10 match key*")
    assert keys + more[1] == ["key0", "key2", "key3", "key4"] and more[0] == 0
    for bad in ("SET k v EX 1", "SCAN x", "SCAN 0 COUNT 0", "SCAN 0 MATCH", "GET", "NOSUCH a", "SELECT 1", "HELLO 3", "SHUTDOWN"):
        with pytest.raises(CommandError):
            s.run(bad)
    assert "keyspace.keys:4" in s.run("INFO")
    assert s.run("COMPACT") == "OK" and s.run("DBSIZE") == 4
    assert s.run("FLUSHDB") == "OK" and s.run("DBSIZE") == 0


def test_empty_store(spark):
    log = make(spark, [])
    assert state.dbsize(log).first().n == 0 and scan.read_page(log).keys == []
    assert metrics.live_bytes(log).first()[0] == 0
    assert shared_prefix(b"abc", b"abd") == 2


def test_edit_log_and_validate(spark, tmp_path):
    entries = make(spark, seeded(300, 40, 1, 0.2)).withColumn("file_number", F.floor(F.col("seq") / 100).cast("long")).withColumn("level", F.lit(0))
    edits = layout.seed_edits(layout.file_metadata(entries), 1)
    edit_log.append(edits, f"{tmp_path}/edits")
    edit_log.append(edits.where("ordinal = 0").withColumn("edit_id", F.lit(2).cast("long")).withColumn("kind", F.lit("DELETE")), f"{tmp_path}/edits")
    log = edit_log.read(spark, f"{tmp_path}/edits", binary=False)
    assert edit_log.current(log) == 2
    assert cli.validate(entries, edit_log.as_of(log, 1)).count() == 0
    assert {r.invariant for r in cli.validate(entries, log).collect()} == {"no-orphan-tables"}
    assert [r.edit_id for r in cli.manifest(log).collect()] == sorted(r.edit_id for r in log.collect())


def test_filters_reject_absent_keys(spark):
    entries = make(spark, [(f"k{n}", n, False, "v") for n in range(500)]).withColumn("file_number", F.lit(1).cast("long"))
    asked = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).cast("long").alias("file_number"))
    r = bloom.lookups(entries, asked).first()
    assert (r.probes, r.found) == (1000, 500) and 480 <= r.rejects <= 500


def test_ranges_in_two_thousand_parts(spark):
    rows = spark.range(5000).selectExpr("lpad(cast(id * 7 % 5000 as string), 5, '0') as key", "id")
    got = ranks.ranked(rows, "key", "place", parts=2000)
    assert got.where("cast(key as int) + 1 <> place").count() == 0 and got.count() == 5000
    at = ["b", "d", "f", "h", "j"]
    keys = spark.createDataFrame([(k,) for k in ["a", "b", "c", "d", "e", "i", "j", "z", None]], "key string")
    found = {r.key: r.n for r in keys.withColumn("n", ranks.range_of("key", at)).collect()}
    assert found == {k: sum(c <= k for c in at) if k else 0 for k in found}


def test_counts_below_bounds(spark):
    r = random.Random(5)
    rows = [(f"k{r.randrange(40):03d}",) for _ in range(500)]
    bounds = [(f"k{k:03d}", bool(k % 2)) for k in range(-1, 45, 3)]
    got = ranks.counted_below(spark.createDataFrame(rows, "key string"), "key", spark.createDataFrame(bounds, "bound string, inclusive boolean"), parts=7)
    assert {(x.bound, x.inclusive): x.n for x in got.collect()} == {(b, i): sum(k < b or (i and k == b) for (k,) in rows) for b, i in bounds}


def test_puts_of_one_key_follow_their_order(spark):
    log = make(spark, [("a", 1, False, "0")])
    rows = [("a", str(v), n) for n, v in enumerate([3, 9, 1, 7, 2, 5])]
    for parts in (1, 3, 6):
        new = spark.createDataFrame(rows, "key string, value string, n int").repartition(parts)
        assert state.get(state.put(log, new, "n"), "a").first().value == "5"
        assert state.get(state.put(log, new.drop("n")), "a").first().value == "9"


def test_strict_replay_and_level_zero_order(spark):
    columns = "edit_id long, ordinal int, kind string, level int, file_number long, size long, smallest string, largest string, smallest_seq long, largest_seq long, counter_value long"
    row = lambda e, kind, f: (e, 0, kind, 0, f, 1, "a", "b", 1, 2, None)
    for bad in ([row(1, "ADD", 1), row(2, "DELETE", 9)], [row(1, "RENAME", 1)]):
        with pytest.raises(ValueError, match="corrupt edit log"):
            layout.replay_strict(spark.createDataFrame(bad, columns))
    assert layout.replay_strict(spark.createDataFrame([row(1, "ADD", 1), row(2, "DELETE", 1)], columns)).count() == 0
    files = spark.createDataFrame([(0, n, k, "a", "b") for k, n in enumerate([9, 7, 8, 3])], "level int, file_number long, position int, smallest string, largest string")
    assert [r.detail for r in check.version_structure(files).collect()] == ["0:8"]


def test_table_readable(spark, tmp_path):
    make(spark, [("a", 1, False, "x")]).coalesce(1).write.parquet(str(tmp_path / "t"))
    good = str(next((tmp_path / "t").glob("*.parquet")))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 nothing PAR1")
    paths = spark.createDataFrame([(1, good), (2, str(tmp_path / "bad.parquet")), (3, str(tmp_path / "none.parquet"))], "file_number long, path string")
    assert {r.detail for r in check.table_readable(paths.select("file_number"), paths).collect()} == {"2", "3"}


def test_a_file_without_a_filter_may_hold_any_key(spark):
    entries = spark.createDataFrame([(1, "a"), (1, "b")], "file_number long, key string")
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (2, "q")], "file_number long, key string")
    assert {(r.key, r.file_number) for r in bloom.probe(bloom.build(entries), asked).collect()} == {("a", 1), ("a", 2), ("q", 2)}


def test_rolled_files_end_at_the_threshold(spark):
    log = make(spark, [(f"k{n:04d}", n + 1, False, "v" * (n % 50)) for n in range(2000)]).withColumn("file_number", F.lit(1)).withColumn("level", F.lit(0))
    options = compact.Options(output_bytes=1000)
    files = layout.file_metadata(compact.rolled(log, options, 40)).orderBy("smallest").collect()
    assert [f.file_number for f in files] == list(range(41, 41 + len(files)))
    assert all(a.largest < b.smallest for a, b in zip(files, files[1:], strict=False))
    assert all(f.size < 1000 + 200 for f in files) and sum(f.size >= 1000 for f in files) >= len(files) - 4


def test_delete_effects_across_parts(spark):
    rows = seeded(600, 5, 8, 0.5)
    alive, existed = set(), 0
    for key, _, dead, _ in rows:
        existed += dead and key in alive
        (alive.discard if dead else alive.add)(key)
    for parts in (1, 7, 64):
        assert state.delete_effects(make(spark, rows), parts).first() == (sum(r[2] for r in rows), existed)


def test_unfiltered_lookups_make_no_pairs(spark, monkeypatch):
    r = random.Random(4)
    rows = [(f"k{r.randrange(60):02d}", s, False, "v", s // 20, 0) for s in range(1, 300)]
    log = make(spark, rows, ", file_number long, level int")
    files = layout.file_metadata(log.where("file_number % 4 > 0 or key between 'k20' and 'k30'"))
    keys = spark.createDataFrame([(f"k{n:02d}",) for n in range(0, 70, 3)] + [(None,)], "key string")
    want = bloom.lookups(log, layout.candidates(keys, files), filtered=False)
    got = metrics.unfiltered_lookups(log, keys, files)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) != []
    asked = {f.file_number: sum(f.smallest <= k <= f.largest for k in ("k03", "k03", "k21", "z")) for f in files.collect()}
    repeated = spark.createDataFrame([("k03",), ("k03",), ("k21",), ("z",)], "key string")
    assert {x.file_number: x.probes for x in metrics.unfiltered_lookups(log, repeated, files).collect()} == {f: n for f, n in asked.items() if n}
    monkeypatch.delattr(layout, "candidates")
    assert registry.queries()["lookups_unfiltered"](spark, "/root/testdata/sf0.001").count() > 0


def test_candidates_of_wide_files_spread_over_tasks(spark, monkeypatch):
    """Files that hold any key make many pairs of two small tables; no task joins more than a share of them."""
    monkeypatch.setattr(layout, "PAIRS_A_TASK", 1000)
    monkeypatch.setattr(layout, "KEYS_A_BIN", 50)
    keys = [f"k{n:03d}" for n in range(400)]
    bounds = [(0, n, keys[n % 7], keys[-1 - n % 5]) for n in range(120)] + [(1, 500 + n, keys[50 * n], keys[50 * n + 49]) for n in range(8)]
    files = spark.createDataFrame(bounds, "level int, file_number long, smallest string, largest string")
    found = layout.candidates(spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string"), files)
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.key, r.level, r.file_number) for r in got) == sorted((k, level, n) for level, n, low, high in bounds for k in keys if low <= k <= high)
    assert max(Counter(r.task for r in got).values()) < len(got) / 4


def test_settle_takes_rounds_by_levels_not_by_files(spark):
    """24 groups of files that don't meet: compactions run side by side, so few rounds settle the tree."""
    rows = [(f"{s // 60:02d}-{random.Random(s).randrange(25):02d}", s + 1, s % 5 == 0, None if s % 5 == 0 else f"v{s}") for s in range(1440)]
    log = make(spark, rows).withColumn("file_number", F.floor((F.col("seq") - 1) / 20).cast("long")).withColumn("level", F.lit(0))
    options = compact.Options(base_bytes=1500, output_bytes=300, multiplier=4)
    done = compact.settle(log, options, most=8)
    assert {r.key: r.value for r in state.live(done).collect()} == model(rows)
    files = layout.file_metadata(done)
    assert check.report(files, done, files.select("file_number", "size"), 1440).count() == 0
    assert compact.worst_level(files, options).isEmpty() and files.select("level").distinct().count() > 2


def test_rounds_keep_compactions_apart(spark):
    rows = [(1, 1, 10, "a0", "a9"), (1, 2, 10, "c0", "c9"), (1, 3, 10, "e0", "e9"), (2, 4, 10, "b0", "b9"), (2, 5, 10, "c5", "d0"), (3, 6, 5, "d0", "d1")]
    files = spark.createDataFrame(rows, "level int, file_number long, size long, smallest string, largest string")
    every = compact.pick_round(files, compact.Options(base_bytes=1))
    assert sorted(every.inputs) == [(1, 1, True), (1, 2, False), (1, 3, True), (2, 5, False)] and every.apart == ("c0",)
    pointers = {1: "c9"}
    assert compact.pick_round(files, compact.Options(base_bytes=25), pointers).inputs == [(1, 3, True)] and pointers == {1: "e9"}
    assert compact.pick_round(files, compact.Options(base_bytes=100)) is None
