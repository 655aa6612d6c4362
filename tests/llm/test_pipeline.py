"""The pipeline's stages on planted documents, each stage on what the one before kept."""

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
from tidelog.llm import cells, common, op8_suffix_dedup, op10_simhash


def test_stages(spark, docs_of, tmp_path):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, copied = prose(60), prose(200)
    rows = [(k, prose(120), "en", f"s{k % 3}") for k in range(40)]
    rows += [(50 + k, copied, "en", "s1") for k in range(4)] + [(60 + k, prose(50) + " " + passage + " " + prose(50), "en", "s2") for k in range(3)]
    rows += [(80, "too short", "en", "s0"), (81, "spam and eggs and ham " * 30, "en", "s0"), (82, None, "en", "s0")]
    docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        if name != "pack_sequences":
            assert found.columns == docs.columns
        found.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(docs.collect())
    quality, near, suffix, mixed, packed = out
    assert {x.doc_id for x in quality} == {i for i, *_ in rows} - {80, 81, 82}
    assert {x.doc_id for x in near} == {x.doc_id for x in quality} - {51, 52, 53}
    assert {x.doc_id for x in suffix} == {x.doc_id for x in near}
    assert [passage in x.text for x in sorted(suffix, key=lambda x: x.doc_id)[-3:]] == [True, False, False]
    assert all(len(x.text) == x.n_chars for x in [*quality, *near, *suffix, *mixed])
    n, total = (sum(len(x.text.split()) for x in part) for part in (mixed, suffix))
    assert abs(n - 1.5 * total) < 0.05 * total
    taken = Counter()
    for x in mixed:
        taken[x.doc_id] += len(x.text.split())
    assert all(taken[x.doc_id] <= 2 * len(x.text.split()) for x in suffix)
    assert {x.doc_id for x in packed} == {x.doc_id for x in mixed}
    assert corpus_pipeline.ORACLE_SQL is None and op10_simhash.RADIUS == 3


def test_near_dedup_drops_no_unlinked_row_of_a_null_or_repeated_id(spark, docs_of):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    copied = prose(200)
    rows = [(None, prose(120)) for _ in range(4)] + [(7, prose(120)) for _ in range(3)]
    clean = {t for _, t in rows} | {copied}
    rows += [(3, copied), (7, copied), (7, copied), (None, copied), (9, None), (None, "")]
    found = [(x.doc_id, x.text) for x in corpus_pipeline.simhash_near_dedup(spark, docs_of(rows), "").collect()]
    assert Counter(found) == Counter([x for x in rows if x[1] in clean - {copied}] + [(3, copied), (9, None)])


def test_run_equals_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_keep_columns_of_any_name_and_type(spark, sample):
    """Names that operators use inside, and types of all kinds; null and shared ids; distinct texts survive the near-duplicates."""
    import datetime

    more = "kept int, n_bytes double, parts array<int>, _text boolean, _host timestamp, host string, hash struct<a: int>, cell map<string, int>, row date, pass binary, times int, doc string, id int"
    extra = (7, 0.5, [1, None], True, datetime.datetime(2024, 1, 2), "h", (3,), {"a": 1}, datetime.date(2024, 1, 2), b"x", None, "d", 9)
    unlike = [(i, " ".join(f"{c}{k * k % 97}" for k in range(60)), "en", "s", 1) for i, c in ((None, "a"), (None, "b"), (7, "c"), (7, "d"))]
    rows = [(i, t, "en", "s" if k % 2 else None, None) for k, (i, t) in enumerate(sample)] + unlike
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        found = out.collect()
        assert found and all(r.parts == [1, None] and r.hash.a == 3 and r["pass"] == b"x" and r["_host"].year == 2024 for r in found), name
        docs = spark.createDataFrame(found, docs.schema)
        if name != "mix_to_weights":
            assert {t for _, t, *_ in unlike} <= {r.text for r in found}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_suffix_stage_in_passes_bounds_what_it_sends(spark, docs_of, sample, monkeypatch):
    """Stage three with contexts that outgrow its cells: no exchange has them all, and rows with all their columns are those of one pass."""
    docs = docs_of([(i, t, "en", f"s{k % 3}") for k, (i, t) in enumerate(sample) if i != 90])
    want = Counter(map(tuple, corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()))
    sent, exchange = [], op8_suffix_dedup.exchange

    def noted(parcels, *args, **settings):
        columns = [cells.unpacked_columns(bytes(x.blob)) for x in parcels.collect()]
        sent.append(sum(len(c[0]) for c in columns if len(c) == 7))  # contexts have seven columns
        return exchange(parcels, *args, **settings)

    monkeypatch.setattr(op8_suffix_dedup, "exchange", noted)
    monkeypatch.setattr(op8_suffix_dedup, "PASS", 0.05, raising=False)
    assert Counter(map(tuple, corpus_pipeline.suffix_array_dedup(spark, docs, "").collect())) == want
    assert 0 < max(sent) < sum(sent) / 2


def test_run_leaves_no_table_of_a_stage_that_is_done(spark):
    """The tables between phases, cells among them, go once their stage's result is written; the last one is still read."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    had = set(shared.iterdir())
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = sorted(x.name.partition("-")[0] for x in set(shared.iterdir()) - had)
    assert left == ["mix_to_weights"] and found.count() > 0


def test_shuffle_files_go_once_a_stage_is_written(spark, docs_of, sample):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    for _ in range(3):
        common.release(spark)  # what other tests have left
    had = files()
    written = common.Written(corpus_pipeline.quality_rules(spark, docs_of(sample), ""), "quality")
    assert files() > had
    common.release(spark)
    assert files() <= had and written.read().count() > 0


def test_mixing_stage_shuffles_texts_once(spark, docs_of, sample):
    """Also where rows repeat and ids are null: every word of a source that is asked for twice comes twice."""
    rows = [(i, t, "en", "s") for i, t in sample] + [(7, "a b c", "en", "s")] * 3 + [(None, "d e", "en", None)] * 3
    out = corpus_pipeline.mix_to_weights(spark, docs_of(rows), "")
    nodes, dealt = [out._jdf.queryExecution().executedPlan().initialPlan()], 0
    while nodes:
        node = nodes.pop()
        columns = [node.output().apply(k).name() for k in range(node.output().size())]
        dealt += node.nodeName() == "Exchange" and "doc" in columns
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert dealt == 1
    taken = Counter(w for x in out.collect() if x.source is None for w in x.text.split())
    assert taken == {"d": 6, "e": 6}


def test_stages_of_an_empty_table(spark, docs_of):
    docs = docs_of([(1, "x")]).where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
