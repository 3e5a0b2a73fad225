"""Operators 11 to 13 against plain versions, and their edge cases."""

import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from hypothesis.extra import numpy as arrays
from pyspark.sql import functions as F
from test_llm import DOCS, LONG, ODD, docs_of, odd

from eventlake.llm import audit, boosting, codebooks, media, quality, queries, urls

# 11 Codebooks


@given(arrays.arrays(np.int64, st.tuples(st.integers(1, 12), st.just(7)), elements=st.integers(-40, 40)), arrays.arrays(np.int64, st.tuples(st.integers(1, 20), st.just(7)), elements=st.integers(-40, 40)))
def test_bounded_search_is_exact(x, c):
    blocks = (1, 2, 4)
    index, d, _ = codebooks.assigned(x, codebooks.Bounds(c, blocks), blocks)
    all_ = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert index.tolist() == all_.argmin(axis=1).tolist() and d.tolist() == all_.min(axis=1).tolist()


def test_bounds_leave_entries_out_and_never_exceed_the_distance():
    rng = np.random.default_rng(3)
    c = np.cumsum(rng.normal(0, 60, (256, 16)), axis=1).astype(np.int64)
    x = c[rng.integers(0, 256, 400)] + rng.integers(-9, 10, (400, 16))
    blocks = codebooks.CodebookConfig().blocks
    a, b = codebooks.Bounds(x, blocks), codebooks.Bounds(c, blocks)
    true = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    before = np.zeros_like(true, float)
    for i, j in zip(a.levels, b.levels, strict=True):
        bound = ((i[:, None] - j[None]) ** 2).sum(axis=2)
        assert (bound <= true * (1 + 1e-9) + 1e-6).all() and bound.mean() > before.mean()
        before = bound
    assert codebooks.assigned(x, b, blocks)[2] < 0.2 * true.size


def test_bounds_hold_for_components_of_any_size():
    rng = np.random.default_rng(4)
    most = codebooks.most_component(64)
    for scale in (1, 1000, most):
        x, c = (rng.integers(-scale, scale + 1, (n, 16)) for n in (50, 256))
        c[128:] = c[:128]  # ties: the lower index
        index, d, _ = codebooks.assigned(x, codebooks.Bounds(c, (1, 4)), (1, 4))
        all_ = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert index.tolist() == all_.argmin(axis=1).tolist() and d.tolist() == all_.min(axis=1).tolist()


def slow_codes(rows, entries=256, rounds=4):
    """Codes of (vec_id, label, vector) rows of one length by plain Python."""
    kept = sorted(((i, [int(np.floor(1024 * np.float64(c))) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // 4
    books = [[r[1][p * d : p * d + d] for r in kept[:entries]] for p in range(4)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for turn in range(rounds + 1):
        codes = [[nearest(p, r[1][p * d : p * d + d]) for p in range(4)] for r in kept]
        if turn < rounds:
            for p in range(4):
                for e in range(len(books[p])):
                    mine = [r[1][p * d : p * d + d] for r, c in zip(kept, codes, strict=True) if c[p][1] == e]
                    if mine:
                        books[p][e] = [sum(xs) // len(mine) for xs in zip(*mine, strict=True)]
    total = Counter()
    for r, c in zip(kept, codes, strict=True):
        total[r[2]] += sum(x for x, _ in c)
    sha = codebooks.digest(np.array(books))
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in c), sum(x for x, _ in c), total[r[2]], sha) for r, c in zip(kept, codes, strict=True)), key=str)


def test_codes_against_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 1, 8)], int(i) % 3 if i % 5 else None) for i in rng.permutation(90)]
    rows += rows[:4] + [(None, [0.5] * 8, 1), (95, None, 1), (96, [1.0, None] * 4, 1), (97, [float("nan")] * 8, 1), (98, [float("-inf")] * 8, 2), (99, [0.0] * 8, 7)]
    config = codebooks.CodebookConfig(entries=16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"size": F.lit("x"), "code": F.lit(1), "_label": F.lit(2)}).repartition(5)
    got = sorted(map(tuple, codebooks.coded(df, config).collect()), key=str)
    assert got == slow_codes(rows, 16)


def test_codes_edges(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert codebooks.coded(spark.createDataFrame([], kind)).count() == 0
    assert codebooks.coded(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    rows = [(1, [], 1), (2, [1.0, 2.0, 3.0], 1), (3, [1.0, 2.0, 3.0], None), (4, [1e300, -1e300, 0.0, 1.0], 5), (5, [float(k) for k in range(9)], 1), (1, [], 1)]
    got = codebooks.coded(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 6 and all(r["error"] == 0 and r["label_error"] == 0 for r in got)
    assert len({r["codebooks_sha256"] for r in got}) == 2  # lengths 0, 3, 4 are filled up to 4, length 9 to 12


# 12 Quality


def slow_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(hit)]


@given(st.lists(st.text(alphabet="ab \n\t\x0b#|é", max_size=40), max_size=6))
def test_counts_against_a_plain_version(texts):
    assert np.transpose(quality.counted([t.encode() for t in texts])).tolist() == [slow_counts(t) for t in texts] if texts else True


def test_counts_of_long_and_odd_texts(spark):
    got = {r["doc_id"]: r for r in quality.report(odd(spark)).collect() if r["doc_id"]}
    for i, t, *_ in ODD:
        if i:
            n, chars, symbols, _, dups, repeats = slow_counts(t)
            assert (n, chars, symbols, dups, repeats) == tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got[1]["base_failed"] and not got[1]["kept"] and quality.report(odd(spark)).count() == len(ODD)
    assert quality.report(odd(spark, [])).count() == 0
    assert slow_counts(LONG)[0] == 24_000


def test_sketches_merge_to_the_same_and_bound_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), int(v)) for k, v in zip(rng.integers(0, 3, 4000), rng.lognormal(6, 2, 4000), strict=True)]
    df = spark.createDataFrame(rows, "k int, v long")
    whole = quality.sketch(df, ["k"], {"r": F.col("v")})
    halves = quality.merged(quality.sketch(df.where("v % 2 = 0"), ["k"], {"r": F.col("v")}).union(quality.sketch(df.where("v % 2 = 1"), ["k"], {"r": F.col("v")})), ["k"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, halves.collect()))
    assert whole.count() < 3 * 1000
    q = {r["k"]: r for r in quality.quantiles(whole, ["k"], {"p10": 10, "p90": 90}).collect()}
    for k in range(3):
        vs = sorted(v for a, v in rows if a == k)
        for name, p in (("p10", 10), ("p90", 90)):
            exact = vs[-(-len(vs) * p // 100) - 1]
            assert exact * (1 - 1 / 64) - 1 <= q[k][name] <= exact
        assert q[k]["docs"] == len(vs)


def planted(n=300):
    """Two languages whose word lengths differ; in each, some documents that stand out."""
    rows = []
    for lang, word in (("aa", "abcd"), ("bb", "abcdefghijkl")):
        for i in range(n):
            words = [f"{word}{(i * 7 + j * j) % 89:02d}" for j in range(80)]
            rows.append((len(rows), " ".join(words), lang, f"s{i % 2}", 0))
        rows.append((len(rows), " ".join(f"{w}###" for w in words), lang, "s0", 0))
        other = "abcdefghijkl" if lang == "aa" else "abcd"
        rows.append((len(rows), " ".join(f"{other}{j}" for j in range(80)), lang, "s1", 0))
    return rows


@pytest.mark.parametrize("least", [100, 200, 10_000])
def test_thresholds_follow_the_group(spark, least):
    """A word length that is usual in one language stands out in the other, unless all share thresholds."""
    config = quality.QualityConfig(least_docs=least)
    rows = planted()
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in quality.report(df, config).collect()}
    failed = {k: r["failed_rules"] for k, r in got.items() if not r["kept"]}
    if least <= 200:  # own sketches, or those of the language
        assert failed == {300: "symbols,word_length", 301: "word_length", 602: "symbols,word_length", 603: "word_length"}
    else:  # everybody's: both lengths are usual
        assert set(failed) == {300, 602}
    level = {r["level"] for r in quality.thresholds(quality.measured(df), config).collect()}
    assert level == {100: {0}, 200: {1}, 10_000: {2}}[least]


def test_filtered_keeps_columns_and_rows(spark, sf):
    docs = docs_of(spark, sf).withColumns({"n_words": F.lit("x"), "level": F.lit(None).cast("int"), "_lang": F.lit(1)})
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    want = sorted(r["doc_id"] for r in quality.report(docs).where("kept").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert len(want) > 0.5 * docs.count()


# 13 Audit


def slow_audit(rows, labels):
    fails, first = [], {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in range(2))
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in first and i > first[t]}
        fails.append((source or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        total, each = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order):
                gone = [x for x in left if k in x[1]]
                left = [x for x in left if k not in x[1]]
                total[k] += len(gone)
                each.append((part, "".join(order), step + 1, len(left), len(gone), sum(k in x[1] for x in mine) - len(gone), sum(x[1] == {k} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out |= {r[:3]: (*r[3:], total[r[1][r[2] - 1]]) for r in each}
    return out


def test_audit_against_all_orders(spark):
    rows = [*ODD, (11, "A " * 300, "en", "a", 0), (12, "A " * 300, "en", None, 0), (13, "x # " * 250, "en", "b", 0), (14, LONG, "en", "b", 0), (None, LONG, "en", "b", 0), (13, "x # " * 250, "en", "b", 0)]
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (10, None, 1), (None, 1, 1), (12, 1, None), (14, 1, 1), (13, 0, 1)]
    docs = odd(spark, rows).withColumns({"part": F.lit(1), "A": F.lit("y"), "id": F.lit(0)})
    got = audit.audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == slow_audit(rows, labels)
    assert len(got) == 600 * 5


def test_audit_edges_and_visits(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(odd(spark, []), labels).count() == 0
    assert audit.audited(odd(spark), labels).agg(F.sum("good_lost")).first()[0] == 0
    # Each set of filters is visited once, whichever of its orders comes first; nothing stays persisted.
    rows = spark.createDataFrame([("p", bool(i & 1), bool(i & 2), bool(i & 4), i == 7) for i in range(8)], "part string, x boolean, y boolean, z boolean, m boolean")
    walk = audit.walked(rows, ["x", "y", "z"], ["m"]).collect()
    assert sorted(r["state"] for r in walk) == list(range(7)) and all(r["total"] == 8 >> r["state"].bit_count() for r in walk)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


@pytest.mark.parametrize("name", ["op11_codebooks", "op12_quality", "op13_audit"])
def test_queries_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


# 2 URL filters: the trees


def slow_features(url):
    """Features without the suffix rates, from their definitions."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?(#?)", rest, re.S)
    host, path, query, mark = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2], m[3] or "", m[4]
    n = max(1, len(url))
    entropy = -sum(url.count(c) / n * math.log2(url.count(c) / n) for c in set(url))
    return [len(url), len(host), len(path), path.count("/"), len(host.split(".")), sum(map(str.isdigit, url)) / n, sum(map(str.isupper, url)) / n, entropy, len(query.split("&")) if query else 0, max(map(len, path.split("/"))), host.count("-"), float(bool(mark))]


@given(st.text(alphabet="aZ0-./?#&:é\n", max_size=30).map(lambda t: f"http://{t}") | st.none() | st.text(max_size=9))
def test_features_against_their_definitions(url):
    got = urls.features(url, np.zeros((16, 2)))
    assert got[:12] == pytest.approx(slow_features(url)) and got[12:] == [0.5, 0.5]


def test_suffix_rates_count_every_labelled_row(spark):
    rows = [("http://a.bad.org/x", 1)] * 30 + [("http://b.bad.org/y", 0)] * 10 + [("http://c.good.org/z", 0)] * 50 + [("http://q.org", None)] * 9 + [(None, 1)]
    model = urls.train(spark.createDataFrame(rows, "url string, label int"), urls.UrlConfig(rounds=2))
    got = urls.features("http://zz.bad.org/other", model.stats)[12:]
    assert got == [(30 + 10) / (90 + 20), (30 + 10) / (40 + 20)]
    assert (model.stats.sum(axis=0) == [2 * 91, 2 * 31]).all()


def slow_boost(x, y, w, rounds, depth, rate=0.2, bins=32, penalty=1.0):
    """The same boosting, one node and threshold at a time: scores of the training rows."""
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    mean = ((w * y).sum() + 0.5) / (w.sum() + 1)
    score = np.full(len(y), math.log(mean / (1 - mean)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            after = []
            for rows in nodes:
                best, split = 1e-9, None
                gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)  # noqa: B023, E731
                for j, e in enumerate(edges):
                    for t in e:
                        left, right = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                        value = gain(left) + gain(right) - gain(rows)
                        if value > best + 1e-9:
                            best, split = value, (left, right)
                after += split or (rows, rows[:0])
            nodes = after
        for rows in nodes:
            score[rows] += rate * g[rows].sum() / (h[rows].sum() + penalty)
    return score


def test_boosting_against_a_plain_version():
    rng = np.random.default_rng(8)
    x = np.round(rng.random((120, 3)), 2)
    y, w = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 120) > 0.7).astype(float), rng.integers(1, 5, 120).astype(float)
    trees = boosting.fit(x, y, w, rounds=4, depth=3)
    assert trees.score(x) == pytest.approx(slow_boost(x, y, w, 4, 3), abs=1e-6)


def labelled_urls(n=4000):
    """URLs whose label follows from digits in the host and parameters; some of them very often."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(n):
        bad = int(rng.random() < 0.4)
        host = "".join(rng.choice(list("0123456789" if bad else "abcdefgh"), 9)) + f".s{rng.integers(0, 40)}.org"
        query = "?" + "&".join(f"p{k}={rng.integers(0, 999)}" for k in range(rng.integers(3, 9))) if bad and rng.random() < 0.8 else ""
        rows.append((i, f"http://{host}/{'a/' * int(rng.integers(0, 4))}x{query}", bad))
    return rows


def test_trees_learn_held_out_urls_from_a_label_column(spark):
    rows = labelled_urls()
    hot = [(10_000 + i, "http://hot.s1.org/again", 0) for i in range(2000)]  # a third of the training rows
    train = spark.createDataFrame([r for r in rows if r[0] % 2 == 0] + hot, "page_id long, url string, label int")
    config = urls.UrlConfig(rules=(), max_rows=1500)
    model = urls.train(train, config)
    held = [r for r in rows if r[0] % 2]
    got = {r["page_id"]: r["verdict"] for r in urls.judged(spark.createDataFrame(held, "page_id long, url string, label int"), config, model).collect()}
    said = [r for r in held if got[r[0]] == "block"]
    assert sum(r[2] for r in said) / len(said) > 0.95 and sum(r[2] for r in said) / sum(r[2] for r in held) > 0.95
    assert not model.block_share(["http://hot.s1.org/again"])[0] > 0.5


def test_url_query_is_its_operator(spark, sf):
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op2_urls(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    ruled = urls.with_rule(pages)
    model = urls.train(urls.rule_labels(ruled))
    for r in ruled.collect():
        share = float(model.block_share([r["url"]])[0])
        assert got[r["page_id"]] == (r["host"], r["path"], r["rule"], r["rule_verdict"] or ("block" if share > 0.5 else "allow"), pytest.approx(share))


# 3 Media: features


def test_resampling_by_its_definition():
    rng = np.random.default_rng(2)
    x = rng.integers(-32768, 32768, 501).astype(np.int16)
    twice = media.resampled(x, 8000, 16000).tolist()
    assert twice[::2] == x.tolist() and twice[-1] == x[-1]
    assert twice[1:-1:2] == [(int(a) + int(b)) // 2 for a, b in zip(x, x[1:], strict=False)]
    for low, high in ((8000, 11025), (8000, 4000)):
        got = media.resampled(x, low, high)
        assert len(got) == len(x) * high // low
        for k, v in enumerate(got.tolist()):
            at = k * low / high
            a, b = int(x[int(at)]), int(x[min(int(at) + 1, len(x) - 1)])
            assert abs(v - (a + (b - a) * (at - int(at)))) <= 0.5 + 1e-6
    assert media.resampled(x[:0], 8000, 16000).tolist() == [] and media.resampled(x, 8000, 8000) is x


@given(st.lists(st.integers(-32768, 32767), max_size=50))
def test_summary_by_its_definition(xs):
    n, peak, rms, changes = map(int, media.summary(np.array(xs, np.int16)).split(","))
    assert (n, peak, changes) == (len(xs), max(map(abs, xs), default=0), sum((a < 0) != (b < 0) for a, b in zip(xs, xs[1:], strict=False)))
    assert rms == (int((sum(x * x for x in xs) / len(xs)) ** 0.5 * 1000) if xs else 0)


def test_media_query_features_are_the_stored_forms(spark, sf):
    rows = queries.op3_media(spark, sf).join(docs_of(spark, sf).select("doc_id", "text"), "doc_id").collect()
    config = media.MediaConfig()
    for r in rows[:60]:
        raw = (r["text"] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        pcm = media.mulaw_table()[np.frombuffer(payload, np.uint8)]
        out = media.resampled(pcm, config.rate_in, config.rate_out).astype("<i2").tobytes()
        assert r["pcm_crc32"] == zlib.crc32(out) and f"pcm{config.rate_out}:{zlib.crc32(out):08x}" in r["feature"]
        assert r["feature"].startswith(f"mulaw:{media.summary(pcm)};") and f"alaw:{media.summary(media.alaw_table()[np.frombuffer(payload, np.uint8)])};" in r["feature"]


def test_media_longer_than_a_slice(spark):
    text = "telephone " * 900_000
    r = media.loaded(media.stored(spark.createDataFrame([(1, "a"), (2, text), (3, None)], "doc_id long, text string"))).where("doc_id = 2").first()
    assert bytes(r["payload"])[: len(text)].decode() == text and r["n_bytes"] == len(text)
