"""Every operator against a brute-force version, on rows with nulls, ties, copies and long texts."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import cells, common, components, elias_fano, op1_token_counts, op2_language_id, op3_html_text, op4_lm_scoring, op5_mixing, op6_media, op7_quality, op8_suffix_dedup, op9_packing, op10_simhash, suffixes


def text_of(t):
    return (t or "").encode()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op1_token_counts.vocabulary_path())


@pytest.mark.parametrize("head", [1 << 18, 40, 0])
def test_token_counts(docs_of, sample, tokenizer, head):
    sample = [*sample, (97, "Hello, hello. HELLO,world!! naïve Ångström. " + "w" * 300 + " x" * 70)]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in op1_token_counts.token_counts(docs_of(sample), head=head).collect())
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((i, len(text_of(t)), n(t), n(t) > 2048) for i, t in sample)


def test_pretoken_table_counts_each_once(docs_of, sample, tokenizer):
    rows = op1_token_counts.pretoken_table(docs_of(sample), op1_token_counts.vocabulary_path()).collect()
    assert len({r.part for r in rows}) == len(rows)
    assert all(r.pieces == len(tokenizer.encode(r.part, add_special_tokens=False).ids) for r in rows)
    assert sum(r.uses * r.pieces for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in sample)


def test_packing_round_trip(docs_of, sample, tokenizer):
    rows = [r for r in sample if r[0] is not None and r[0] != 8]
    got = op9_packing.pack(docs_of(rows), with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[i])) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    assert op9_packing.pack(docs_of([(8, "a"), (8, "a"), (None, None)])).count() == 3


def test_closest_fill_is_exact_subset_sum():
    p = op9_packing.Packer(100, 0)
    for n, c in Counter([70, 41, 21, 23, 23, 9, 6]).items():
        for _ in range(c):
            p.pool[n].append(("d", 0))
    assert sum(p.closest(100)) == 100 and 70 in p.closest(100)


def test_language(docs_of):
    import random

    r = random.Random(1)
    make = {"aa": lambda: "".join(r.choice("abcde") for _ in range(6)), "zz": lambda: "".join(r.choice("vwxyzé") for _ in range(6))}
    rows = [(k, " ".join(make[x]() for _ in range(20)), x) for k, x in enumerate(["aa", "zz"] * 20)]
    rows += [(100, None, "aa"), (101, " 12 \n", "zz"), (102, "abc", None), (None, "vwx", None)]
    got = {r.doc_id: r for r in op2_language_id.predict(docs_of(rows), op2_language_id.train(docs_of(rows[:30]))).collect()}
    assert all(got[k].lang_pred == rows[k][2] for k in range(40)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "aa" and got[None].lang_pred == "zz"
    assert {r.lang_pred for r in op2_language_id.predict(docs_of(rows), {}).collect()} == {"und"}
    assert op2_language_id.held_out(3) == (zlib.crc32(b"3") % 3 == 1)


def _profile(p, text):
    """Bound and bundled one n-gram at a time."""
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    line = [0 if c == " " else ord(c) for c in " " + " ".join(low.split()) + " "]
    vector = {c: p.letters(np.array([c]))[0].astype(int) for c in set(line)}
    return sum(vector[line[k]] * np.roll(vector[line[k + 1]], 1) * np.roll(vector[line[k + 2]], 2) for k in range(len(line) - 2))


def test_language_profile_is_the_bundle_of_bound_letters(monkeypatch):
    for most in (op2_language_id.LETTERS, 30):  # with few letter vectors kept they are made again
        monkeypatch.setattr(op2_language_id, "LETTERS", most)
        p = op2_language_id.Profiles(64)
        texts = ["abca", "Ünï  1 \n Ça", "їжак і Ґава", "日本語の文", "x", "ǅ İ"]
        counted = [np.unique(p.codes(t), return_counts=True) for t in texts]
        assert (p.bundles(counted) == [_profile(p, t) for t in texts]).all()
        assert all((p.bundle(*c) == _profile(p, t)).all() for c, t in zip(counted, texts, strict=True))


def test_every_letter_has_a_vector_of_its_own():
    p = op2_language_id.Profiles()
    points = np.unique(p.lower)
    some = points[points < 0x600]
    vectors = p.letters(some).astype(int)
    near = vectors @ vectors.T - len(vectors[0]) * np.eye(len(some), dtype=int)
    assert abs(near).max() < 220 and len({v.tobytes() for v in np.packbits(p.letters(points[:20_000]) > 0, axis=1)}) == 20_000


def test_languages_equal_brute_force(docs_of, monkeypatch):
    """Prototypes, prediction and score by hand, two languages that differ in one letter, a tie, and tables too small to hold a task's n-grams."""
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    make = {"l1": "абвгдеі", "l2": "абвгдеи", "l3": "日月火水木金土", "same as l3": None}
    rows = [(k, " ".join(word(make[x]) for _ in range(30)), x) for k, x in enumerate(["l1", "l2", "l3"] * 12)]
    rows += [(i + 1000, t, "same as l3") for i, t, x in rows if x == "l3"]
    p = op2_language_id.profiles(op2_language_id.DIMENSIONS, 3)
    sums = {x: sum(_profile(p, t) for _, t, lang in rows if lang == x) for x in make}
    for pending in (op2_language_id.PENDING, 100):
        monkeypatch.setattr(op2_language_id, "PENDING", pending)
        found = op2_language_id.train(docs_of(rows))
        assert found.keys() == sums.keys() and all((found[x] == sums[x]).all() for x in sums)
    new = [(k, " ".join(word(make[x]) for _ in range(20)), x) for k, x in enumerate(["l1", "l2", "l3"] * 30)]
    cosine = lambda a, b: (a @ b) / (np.linalg.norm(a) * np.linalg.norm(b))
    for x in op2_language_id.predict(docs_of(new), found).collect():
        mine = {lang: cosine(_profile(p, new[x.doc_id][1]).astype(float), sums[lang].astype(float)) for lang in sums}
        assert x.lang_pred == max(sorted(mine), key=lambda lang: round(mine[lang], 6)) == new[x.doc_id][2]  # a tie goes to l3, the first by name
        assert abs(x.score - mine[x.lang_pred]) < 1e-4


def test_held_out_languages_of_the_test_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text rlike '[a-z]{3}'")
    found = op2_language_id.op2_language_id(spark, sf).where("held_out").select("doc_id", "lang_pred").join(docs, "doc_id").collect()
    assert len(found) > 200 and sum(r.lang_pred == r.lang for r in found) > 0.97 * len(found)


PAGES = [
    (1, "http://h/a", "<html><head><title>t</title><script>x</script></head><body><nav><a href='/'>menu here</a></nav><article><h1>Head &amp; line</h1><p>One <b>bo</b>ld<p>two&nbsp;three</article><footer>foot</footer>", "Head & line One bold two three"),
    (2, "http://h/b", "<body><div>all our pages say this very line</div><div>only page two has these words</div><div class='ad'>buy</div>", "only page two has these words"),
    (3, "http://h/c", "<body><div>all our pages say this very line</div><div>only page three has these other words", "only page three has these other words"),
    (4, "http://other/d", "<div>all our pages say this very line</div>", "all our pages say this very line"),
    (5, None, None, ""),
    (6, "::bad//[", "", ""),
    (7, "http://h/e", "<main>text<section class='comments'>first!</section> 1 &lt; 2 <!-- no --><style>p{}</style></main>", "text 1 < 2"),
    (7, "http://h/e", "<main>text<section class='comments'>first!</section> 1 &lt; 2 <!-- no --><style>p{}</style></main>", "text 1 < 2"),
]


def test_html(spark):
    pages = spark.createDataFrame([(*p[:3], "x", 1) for p in PAGES], "page_id long, url string, html string, text string, key int").repartition(3)
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in op3_html_text.extract(pages).collect())
    assert got == Counter((i, u, t, len(t)) for i, u, _, t in PAGES)


def test_html_repetition_counts_distinct_contents_and_a_share_of_the_host(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    line, phrase, twice = prose(9), prose(8), prose(40)
    bodies = [prose(30) + " " + phrase + " " + prose(30) for _ in range(20)]
    rows = [(k, f"http://h/{k}", f"<div>{line}</div><div>{t}</div>", t) for k, t in enumerate(bodies)]
    rows += [(50 + k, f"http://h/x{u}", f"{nav}<div>{line}</div><div>{twice}</div>", twice) for k, (u, nav) in enumerate((("", ""), ("?utm_source=feed", ""), ("?print", "<nav>print view</nav>")))]
    rows += [(60 + k, f"http://two/{k}", f"<div>{bodies[0]}</div>", bodies[0]) for k in range(2)]
    pages = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string").repartition(3)
    assert {x.page_id: x.text for x in op3_html_text.extract(pages).collect()} == {i: t for i, _, _, t in rows}
    # a paragraph on two of many pages is no boilerplate
    rows = [(k, "http://h/", f"<div>{t}</div>" + f"<p>{twice}" * (k < 2), f"{t} {twice}" if k < 2 else t) for k, t in enumerate(bodies)]
    pages = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string").repartition(3)
    assert {x.page_id: x.text for x in op3_html_text.extract(pages).collect()} == {i: t for i, _, _, t in rows}


def test_html_class_words_swallow_no_article(spark):
    pages = [
        ('<article><div class="post-header"><h1>Title</h1></div><p>one two</article>', "Title one two"),
        ('<div class="wrap has-sidebar"><article>one two</article></div>', "one two"),
        ('<div class="layout with-header"><main>one two</main></div>', "one two"),
        ('<article><p class="alert">one</p> two</article>', "one two"),
        ('<article><div class="social-history">one</div> two</article>', "one two"),
        ('<article><ul class="recipe-menu"><li>one</ul>two</article>', "one two"),
        ('<div class="header"><article>one</article></div><form><main>two</main><input></form>', "one two"),
        ('<main>one<article class="comment">first!</article><div id="comments"><article>second!</article></div><aside>more</aside></main>', "one"),
        ('<body class="ads home"><div class="ad">buy</div><div class="menu">go</div>one two', "one two"),
    ]
    rows = [(k, f"http://{k}/", html) for k, (html, _) in enumerate(pages)]
    got = {x.page_id: x.text for x in op3_html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: t for k, (_, t) in enumerate(pages)}


def _brute_text(pages, run, share, article_share):
    """Texts by counting every run of tokens of every host over its distinct contents."""
    read = [(op3_html_text._host(u), *op3_html_text.candidates(h or "")) for _, u, h in pages]
    read = [(host, zone, [t.split() for t in found]) for host, zone, found in read]

    def stream(found):
        return [w for own in found for w in [*own, None]]

    def keys(found):
        s, at = stream(found), 0
        for k in range(len(s) - run + 1):
            yield k, run, tuple(s[k : k + run])
        for own in found:
            if len(own) + 1 < run:
                yield at, len(own) + 1, (*own, None)
            at += len(own) + 1

    contents = defaultdict(dict)
    for host, zone, found in read:
        contents[host][zone, str(found)] = {x[2] for x in keys(found)}
    out = []
    for host, zone, found in read:
        n = len(contents[host])
        need = max(op3_html_text.ARTICLE_PAGES, math.ceil(article_share * n)) if zone == "article" else max(op3_html_text.PAGES, math.ceil(share * n))
        gone = np.zeros(len(stream(found)), bool)
        for k, size, x in keys(found):
            if sum(x in c for c in contents[host].values()) >= need:
                gone[k : k + size] = True
        covered, at = [], 0
        for own in found:
            covered.append(gone[at : at + len(own)])
            at += len(own) + 1
        out.append(op3_html_text.without(found, covered, zone))
    return out


@pytest.mark.parametrize("fan", [128, 3])
def test_html_runs_equal_brute_force(spark, fan, monkeypatch):
    monkeypatch.setattr(common, "FAN", fan)
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(["al", "be", "ga", "de", "ep"]) + str(r.randrange(12)) for _ in range(n))
    shared = [prose(n) for n in (1, 2, 3, 5, 6, 7, 12, 25, 40)]

    def page(host):
        parts = [f"<p>{prose(r.randrange(1, 40))}" if r.random() < 0.5 else f"<div>{r.choice(shared)}</div>" for _ in range(r.randrange(0, 9))]
        parts.append(f"<p>{prose(20)} {r.choice(shared)} {prose(9)}")
        return f"<article>{''.join(parts)}</article>" if host % 2 else "".join(parts)

    rows = [(k, f"http://h{k % 5}/{k}", page(k % 5)) for k in range(90)]
    rows += [(100 + k, f"http://h{k % 5}/again", rows[k][2]) for k in range(10)] + [(200, None, None), (201, "http://h1/", ""), (None, "http://h1/", "<p>" + prose(9)), (5, "http://h1/", "<p>" + prose(6000))]
    got = op3_html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    want = _brute_text(rows, op3_html_text.RUN, op3_html_text.SHARE, op3_html_text.ARTICLE_SHARE)
    assert Counter((x.page_id, x.url, x.text, x.n_chars) for x in got) == Counter((i, u, t, len(t)) for (i, u, _), t in zip(rows, want, strict=True))
    assert any(t != " ".join(op3_html_text.candidates(h or "")[1]) for (_, _, h), t in zip(rows, want, strict=True))


def test_mix_takes_from_sources_of_less_than_a_block(docs_of):
    docs = docs_of([(1, "word " * 10, "en", "small"), (2, "word " * 5000, "en", "large"), (3, "", "en", "none")])
    got = {x.doc_id: x for x in op5_mixing.mix(docs).collect()}
    assert got[1].target > 0 and got[1].taken == 10 * op5_mixing.wanted_blocks(10, got[1].target) > 0
    assert {x.doc_id for x in op5_mixing.mixed(docs).select("doc_id").collect()} == {1, 2}
    assert [op5_mixing.wanted_blocks(*x) for x in ((10, 20.0), (10, 19.999), (10, 12.0), (10, 3.0), (1000, 20.0), (65, 65.0), (640, 640.0), (640, 330.0), (0, 5.0), (5, 0.0))] == [2, 2, 1, 1, 1, 2, 10, 5, 0, 0]


@pytest.mark.parametrize("fan", [128, 3])
def test_scores(docs_of, sample, fan, monkeypatch):
    monkeypatch.setattr(common, "FAN", fan)
    rows = [r for r in sample if r[0] is not None]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    d = docs_of(rows)
    flag = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = op4_lm_scoring.score(d.withColumn("out", flag), "out", heavy_share=0.05).collect()
    c, pairs, texts = Counter(), defaultdict(Counter), []
    for i, t in rows:
        w = [*text_of(t).lower().split(), "end"]
        texts.append((i, w))
        if not out(i):
            c.update(w)
            for u, x in zip(["begin", *w], w, strict=False):
                pairs[u][x] += 1
    n, v = sum(c.values()), len(c)

    def scored(i, w):
        alone = [math.log10((c[x] + 1) / (n + v + 1)) for x in w]
        total = 0.0
        for u, x, a in zip(["begin", *w], w, alone, strict=False):
            k = pairs.get(u)
            if k is None:
                total += a
                continue
            m, t = sum(k.values()), op4_lm_scoring.BACK_OFF * len(k)
            total += math.log10(k[x] / (m + t)) if k[x] else math.log10(t / (m + t)) + a
        return i, out(i), len(w), sum(c[x] > 0 for x in w), n, sum(alone), total

    want = sorted((scored(i, w) for i, w in texts), key=lambda r: (r[0], r[5]))
    for r, x in zip(sorted(got, key=lambda r: (r.doc_id, r.base_score)), want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:5]
        assert abs(r.base_score - x[5]) < 1e-6 and abs(r.score - x[6]) <= x[2] * op4_lm_scoring.STEP
    assert sum(r.score > r.base_score for r in got) > 0.9 * len(got)


def test_scores_follow_from_the_rows_alone(docs_of, sample):
    """Neither the layout of files nor which contexts are heavy changes a score."""
    flag = (F.col("doc_id") % 7 == 2).alias("out")
    found = []
    for partitions, settings in ((1, {"sample": 20}), (5, {"sample": 20}), (3, {"heavy_share": 1.1}), (3, {"heavy_share": 0.0})):
        rows = op4_lm_scoring.score(docs_of(sample, partitions).select("*", flag), "out", **settings).collect()
        found.append(Counter((r.doc_id, r.n_tokens, round(r.score, 9), round(r.base_score, 9)) for r in rows))
    assert found[0] == found[1] == found[2] == found[3]


def test_parcels_reach_their_shards_in_order(spark):
    n, fan = 50, 3
    assert cells.widths(n, fan) == [27, 9, 3, 1]
    r = np.random.default_rng(7)
    sent = [[r.integers(0, n, 200).astype(np.int32), np.full(200, k, np.int32), np.arange(200, dtype=np.uint64), r.integers(0, 255, (200, 5), dtype=np.uint8)] for k in range(6)]
    rows = [(g, bytearray(x)) for columns in sent for g, x in cells.parcels(columns, n, fan)]
    assert len(rows) <= 6 * fan
    got = cells.exchange(spark.createDataFrame(rows, cells.PARCEL).repartition(3), n, fan).collect()
    found = defaultdict(list)
    for x in got:
        dest, source, place, data = cells.unpacked_columns(bytes(x.blob))
        assert (dest == x.group).all()
        for s, p, d in zip(source.tolist(), place.tolist(), data.tolist(), strict=True):
            found[x.group, s].append((p, d))
    for k, (dest, _, place, data) in enumerate(sent):
        for g in np.unique(dest).tolist():
            assert found[g, k] == [(p, d) for p, d in zip(place[dest == g].tolist(), data[dest == g].tolist(), strict=True)]


def test_elias_fano_and_trie():
    r = np.random.default_rng(1)
    for most in (10, 10**6, 1 << 62):
        x = np.sort(r.integers(0, most, 500, dtype=np.uint64))
        e = elias_fano.EliasFano.of(x)
        assert (e.get(np.arange(500)) == x).all()
        q = np.r_[x, r.integers(0, most, 500, dtype=np.uint64), np.uint64(0), np.uint64(most)]
        assert (e.successor(q) == np.searchsorted(x, q)).all()
    pairs = sorted({(int(a), int(b)) for a, b in zip(r.integers(1, 40, 600), r.integers(1, 1 << 62, 600), strict=True)})
    u, w = (np.array(c, np.uint64) * np.uint64(2 if k == 0 else 1) for k, c in enumerate(zip(*pairs, strict=True)))
    contexts, rank = np.unique(u, return_inverse=True)
    t = elias_fano.Trie(contexts, rank, w, np.arange(len(w)).astype(np.uint8))
    found, place = t.find(u, w)
    assert (place == np.arange(len(w))).all() and (found == rank).all()
    found, place = t.find(np.array([2, 999], np.uint64), np.array([5, 5], np.uint64))
    assert place.tolist() == [-1, -1] and found[1] == -1
    assert t.bytes < 16 * len(w) + 4096


def test_mixing(docs_of):
    import random

    r = random.Random(2)
    rows = [(k, " ".join(["w"] * r.randrange(400)), None, r.choice(["a", "a", "a", "b", "c", None])) for k in range(200)]
    rows += [(500, None, None, "a"), (501, "", None, None), (7, "x y", None, "b"), (7, "x y", None, "b"), (None, "n n n", None, "c")]
    d = docs_of(rows)
    got = op5_mixing.mix(d, block=16).collect()
    assert Counter((x.doc_id, x.size) for x in got) == Counter((i, len((t or "").split())) for i, t, *_ in rows)
    assert all(x.taken <= 2 * x.size for x in got)
    taken = Counter()
    for x in got:
        taken[x.source_size, x.target] += x.taken
    for (_, target), n in taken.items():
        assert abs(n - target) <= max(0.02 * target, 32)
    assert abs(sum(t for _, t in taken) - 1.5 * sum(x.size for x in got)) < 1e-6
    again = op5_mixing.mix(docs_of(rows, 5), block=16).collect()
    assert Counter(x.taken for x in got if x.doc_id != 7) == Counter(x.taken for x in again if x.doc_id != 7)
    out = op5_mixing.mixed(d, block=16)
    assert out.columns == d.columns
    words = Counter()
    for x in out.collect():
        words[x.doc_id] += len(x.text.split())
    assert words == Counter({i: n for i, n in ((x.doc_id, sum(y.taken for y in got if y.doc_id == x.doc_id)) for x in got) if n})


def test_mix_by_hand(docs_of):
    """taken, the shards' composition and the first shard, worked out from blocks, draws and permutations."""
    r = random.Random(9)
    rows = [(k, " ".join(["w"] * r.randrange(300)), None, r.choice(["a", "b", None])) for k in range(80)]
    block, shards, d = 16, 7, docs_of(rows)
    size = {i: len(t.split()) for i, t, *_ in rows}
    order = ["a", "b", None]
    totals = [(s, sum(size[i] for i, _, _, x in rows if x == s)) for s in order]
    goal = op5_mixing.targets(totals)
    blocks = [-(-n // block) for _, n in totals]
    wanted = {k: min(2 * blocks[k], op5_mixing.wanted_blocks(n, goal[s], block)) for k, (s, n) in enumerate(totals)}
    drawn = op5_mixing.draw(wanted, shards)
    slots = {(x.shard, x.slot, x.source): x["index"] for x in op5_mixing.plan(d, block=block, shards=shards).collect()}
    assert Counter((shard, source) for shard, _, source in slots) == Counter({(k, s): int(drawn[k][c]) for k in range(shards) for c, s in enumerate(order) if drawn[k][c]})
    placed = {(x.doc_id): x.start for x in op5_mixing._taken(d, block=block, shards=shards)[0].collect()}
    taken, first = Counter(), {}
    for c, s in enumerate(order):
        of = [i for i, _, _, x in rows if x == s]
        assert sorted(w for i in of for w in range(placed[i], placed[i] + size[i])) == list(range(totals[c][1]))
        edges = np.cumsum(drawn[:, c])
        for slot in range(wanted[c]):
            shard = int(np.searchsorted(edges, slot, side="right"))
            index = int(op5_mixing.permuted(np.array([slot % blocks[c]]), blocks[c], op5_mixing.SEED * 1_000_003 + c * 1009 + slot // blocks[c])[0])
            assert slots[shard, slot, s] == index
            for i in of:
                n = min(placed[i] + size[i], (index + 1) * block) - max(placed[i], index * block)
                if n > 0:
                    taken[i] += n
                    first[i] = min(first.get(i, shard), shard)
    got = op5_mixing.mix(d, block=block, shards=shards).collect()
    assert {x.doc_id: (x.taken, x.first_shard) for x in got} == {i: (taken[i], first.get(i)) for i in size}
    out = op5_mixing.mixed(d, sharded=True, block=block, shards=shards).collect()
    assert {x.doc.doc_id for x in out} == set(first) and len({x.shard for x in out}) == shards


def test_targets_and_draws_and_permutations():
    got = op5_mixing.targets([("b", 100), ("a", 10), (None, 50)])
    # a's weight 5 would give it 140.6; it stops at 20 and the rest share 220 by 2 to 1, of which b stops at none.
    assert got == {"a": 20.0, "b": pytest.approx(146.6666, abs=1e-3), None: pytest.approx(73.3333, abs=1e-3)}
    assert op5_mixing.targets([]) == {}
    drawn = op5_mixing.draw({0: 1000, 1: 10, 2: 0}, shards=7)
    assert drawn.sum(0).tolist() == [1000, 10, 0] and drawn.sum(1).max() <= 145
    for n in (1, 2, 7, 1000):
        assert sorted(op5_mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert op5_mixing.permuted(np.arange(1000), 1000, 5).tolist() != list(range(1000))


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_media(docs_of, sample, hot):
    got = Counter(tuple(r) for r in op6_media.media_columns(docs_of(sample), hot=hot).collect())

    def one(i, t):
        p = op6_media.padded(text_of(t))
        m = op6_media.wave(p)
        x = np.frombuffer(p, np.uint8)
        bins = Counter(b >> 4 for b in p)
        above = [b >= x.mean() for b in p]
        feature = f"mean={sum(p) / len(p):.4f};rms={x.std():.4f};crossings={sum(a != b for a, b in zip(above, above[1:], strict=False))};bins={','.join(str(bins[k]) for k in range(16))}"
        return i, len(text_of(t)), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature

    assert got == Counter(one(i, t) for i, t in sample)


def test_media_files_are_read_back_whole(docs_of, sample):
    import io
    import wave

    store = op6_media.stored(docs_of(sample))
    for r in store.media().collect():
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            assert w.readframes(w.getnframes()) in {op6_media.padded(text_of(t)) for i, t in sample if i == r.doc_id}
    assert store.media().count() == len(sample)
    store.drop()


def test_cuts_follow_content_and_rebuild():
    data = np.random.default_rng(4).integers(97, 120, 200_000, dtype=np.uint8).tobytes()
    parts = list(op6_media.chunks(data))
    assert b"".join(parts) == data and all(len(p) <= op6_media.MOST for p in parts)
    moved = list(op6_media.chunks(b"inserted" + data))
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    h = 0
    for b in data[:500]:
        h = (2 * h + int(op6_media._GEAR[b])) & 0xFFFFFFFF
    whole = op6_media._GEAR[np.frombuffer(data[:500], np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        whole[shift:] += whole[:-shift] << np.uint32(shift)
    assert int(whole[-1]) == h


def _repeat_words(words):
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    return len({k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)})


def test_quality_equals_sql_and_brute_force(docs_of, sample):
    import duckdb

    rows = [(i, t, None, "s" if k % 3 else None) for k, (i, t) in enumerate(sample)] + [(200, "a b c d e f " * 4, None, "s"), (201, "x\nx\n\nx y\n #<", None, "s")]
    rows += [(300 + k, "A line that all of these share\nA line that all of these share", None, "s") for k in range(2)]
    d = docs_of(rows)
    got = [r.asDict() for r in op7_quality.quality(d, share=0, floor=5).collect()]
    pdf = d.toPandas()
    c = duckdb.connect()
    c.register("mine", pdf)
    found = c.execute(op7_quality.sql("mine", share=0, floor=5))
    names = [x[0] for x in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    norm = lambda rs: Counter(tuple(None if r[n] is None or r[n] != r[n] else int(r[n]) for n in sorted(names)) for r in rs)
    assert norm(got) == norm(want)
    assert any(r["removed_words"] for r in got)
    for r in got:
        t = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        w = [x.decode() for x in t.encode().split()]
        if r["doc_id"] is not None:
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), _repeat_words(w))
            assert r["n_symbols"] == sum(t.count(x) for x in "#*$%&|<>")
    kept = {r["doc_id"] for r in got if r["kept"]}
    out = op7_quality.cleaned(d, share=0, floor=5)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == kept
    # The first document that has the line keeps it; the others lose it.
    assert sum("A line that all of these share" in r.text for r in out.collect() if r.source == "s") == 1


def test_line_limits_are_a_share_of_the_host(docs_of):
    """Production parameters: a footer of every seventh text goes, a line of one text in a hundred stays; copies of a text are one text."""
    own = lambda k, n: "\n".join(" ".join(f"w{k}x{j}x{i}" for i in range(12)) for j in range(n))
    footer, quoted, copied = "subscribe to our letter now", "a line that a few of them quote", "nothing but this one line of twelve words in all its many copies"
    rows = [(k, own(k, 3) + (f"\n{footer}" if k % 7 == 0 else "") + (f"\n{quoted}" if k % 100 == 0 else ""), None, "big") for k in range(1400)]
    rows += [(2000 + k, copied, None, "big") for k in range(300)] + [(3000 + k, f"{own(3000 + k, 1)}\n{footer}", None, "small") for k in range(10)]
    notice = " ".join(f"f{i}" for i in range(40))
    rows += [(4000 + k, own(k, 5) + f"\n{notice}", None, "thin") for k in range(12)] + [(6000, f"{notice}\nx", None, "thin")]
    got = {r.doc_id: r for r in op7_quality.quality(docs_of(rows)).collect()}
    assert all(got[k].removed_words == (5 if k % 7 == 0 and k else 0) and got[k].kept for k in range(1400))
    assert all(got[k].removed_words == 0 and got[k].kept for k in [*range(2000, 2300), *range(3000, 3010), 4000])
    assert got[4001].removed_words == got[6000].removed_words == 40 and got[4001].kept and not got[6000].kept
    left = {r.doc_id: r.text for r in op7_quality.cleaned(docs_of(rows)).collect()}
    assert left[0] == rows[0][1] and footer not in left[7] and quoted in left[700] and left[700].startswith(own(700, 3)) and 6000 not in left


def _brute_repeats(rows, length):
    seen, out = defaultdict(lambda: None), []
    key = lambda i: op8_suffix_dedup.NO_ID if i is None else i
    for i, t in rows:
        b = text_of(t)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if seen[w] is None or key(i) < seen[w]:
                seen[w] = key(i)
    for i, t in rows:
        b = text_of(t)
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < key(i):
                gone[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [64, 0])
def test_repeats(docs_of, sample, hot, monkeypatch):
    monkeypatch.setattr(op8_suffix_dedup, "STEP", 3000)
    monkeypatch.setattr(common, "FAN", 5 if hot else 128)
    rows = [r for r in sample if r[0] != 90] + [(95, "x" * 60 + "\0" * 80 + "y" * 60), (96, "\0" * 130 + "z" * 30)]
    got = op8_suffix_dedup.repeats(docs_of(rows), hot=hot)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == _brute_repeats(rows, 50)


@pytest.mark.parametrize("hot", [64, 0])
def test_contexts_that_outgrow_the_corpus_go_in_passes(docs_of, sample, hot, monkeypatch):
    """No exchange holds all contexts where they are more than the corpus, and results are those of one pass."""
    monkeypatch.setattr(op8_suffix_dedup, "PASS", 0.05, raising=False)
    monkeypatch.setattr(common, "FAN", 5)
    exchanged, exchange = [], op8_suffix_dedup.exchange

    def noted(sent, n, *args, **settings):
        columns = [cells.unpacked_columns(bytes(x.blob)) for x in sent.collect()]
        exchanged.append(sum(len(c[0]) for c in columns if len(c) == 7))  # contexts have seven columns
        return exchange(sent, n, *args, **settings)

    monkeypatch.setattr(op8_suffix_dedup, "exchange", noted)
    rows = [r for r in sample if r[0] != 90]
    got = op8_suffix_dedup.repeats(docs_of(rows), hot=hot)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == _brute_repeats(rows, 50)
    assert 0 < max(exchanged) < sum(exchanged) / 2


def test_judging_holds_little_more_than_its_contexts():
    """Of 400,000 strings that share their anchors, a bucket holds no index of all their bytes."""
    import tracemalloc

    r = np.random.default_rng(3)
    n, length, gram = 20_000, 50, op8_suffix_dedup.GRAM
    rows = np.zeros((2 * n, 72), np.uint8)
    rows[:n, :68] = rows[n:, :68] = r.integers(97, 123, (n, 68))
    rows[n:, 0] = 1  # all but the first string of each are shared
    size, anchor, ids = np.full(2 * n, 59, np.int16), np.full(2 * n, 9, np.int16), np.r_[np.arange(n), n + np.arange(n)]
    rows[:, 59:] = 0
    tracemalloc.start()
    entry, start = op8_suffix_dedup._judge(rows, size, anchor, ids, length, gram)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(entry.tolist(), start.tolist(), strict=True)) == [(n + k, s) for k in range(n) for s in range(1, 10)]
    assert peak < 64 << 20


def test_anchors_are_set_by_content():
    r = np.random.default_rng(2)
    a = r.integers(97, 101, 400, dtype=np.uint8).tobytes()
    h, place, first, last = op8_suffix_dedup.anchors(b"qq" + a)
    h2, place2, *_ = op8_suffix_dedup.anchors(a)
    assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == 402 - 50
    assert ((place >= first) & (place <= last + 50 - op8_suffix_dedup.GRAM)).all() or len(place)
    assert set(zip(h2.tolist(), (place2 + 2).tolist(), strict=True)) <= set(zip(h.tolist(), place.tolist(), strict=True))


def test_multikey_groups():
    rows = np.random.default_rng(5).integers(0, 3, (500, 4), dtype=np.uint64)
    order, prefix = suffixes.multikey(rows)
    ordered = list(map(tuple, rows[order].tolist()))
    assert ordered == sorted(ordered)
    want = [next((c for c in range(4) if a[c] != b[c]), 4) for a, b in zip(ordered, ordered[1:], strict=False)]
    assert prefix.tolist() == [0, *want]
    group = suffixes.groups(rows)
    by = defaultdict(set)
    for g, x in zip(group.tolist(), map(tuple, rows.tolist()), strict=True):
        by[x].add(g)
    assert all(len(g) == 1 for g in by.values()) and len(by) == len(set(group.tolist()))


def _brute_fingerprint(t):
    w = text_of(t).lower().split()
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute_components(rows, radius=3):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return [least[find(k)] for k in range(len(rows))]


def test_near_duplicates(docs_of, sample):
    rows = [(i, _brute_fingerprint(t)) for i, t in sample]
    want = Counter((i, f"{h:016x}", c) for (i, h), c in zip(rows, _brute_components(rows), strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in op10_simhash.near_duplicates(docs_of(sample)).collect())
    assert got == want


@pytest.mark.parametrize("hot", [2048, 3])
def test_links_connect_what_is_near(spark, hot):
    import random

    r = random.Random(6)
    found = {r.getrandbits(64) for _ in range(60)}
    for center in list(found)[:6]:
        for _ in range(25):
            x = center
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            found.add(x)
    found = sorted(found)
    df = spark.createDataFrame([(op10_simhash._signed(x),) for x in found], "h long").repartition(3)
    roots = {r.node: r.root for r in components.components(op10_simhash.links(df, hot=hot)).collect()}
    got = [roots.get(s, s) for s in map(op10_simhash._signed, found)]
    want = _brute_components(list(enumerate(found)))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(100)] + [(200, 201), (201, 202), (300, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 101)} | {201: 200, 202: 200}


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "x")]).where("doc_id < 0")
    for f in (op1_token_counts.token_counts, op5_mixing.mix, op5_mixing.mixed, op6_media.media_columns, op7_quality.quality, op7_quality.cleaned, op8_suffix_dedup.repeats, op9_packing.pack, op10_simhash.near_duplicates):
        assert f(none).count() == 0
    assert op2_language_id.predict(none, op2_language_id.train(none)).count() == 0
    assert op4_lm_scoring.score(none.withColumn("out", F.lit(False)), "out").count() == 0
    assert op3_html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
