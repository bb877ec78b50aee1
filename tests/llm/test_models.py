"""Quality (5), mixing (6), toxicity (8), top-k (9) and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing, quality, topk, toxicity

random.seed(13)
GOOD = [f"good{k}" for k in range(80)]
BAD = [f"bad{k}&&&" for k in range(80)]
MEAN = ["vile", "nasty", "foul"]


def labelled_docs(spark):
    rows, labels = [], []
    for k in range(400):
        junk, toxic = k % 5 == 0, k % 7 == 0
        words = [random.choice(BAD if junk else GOOD) for _ in range(random.randint(5, 80))]
        if toxic:
            words += random.choices(MEAN, k=random.randint(2, 8))
        random.shuffle(words)
        rows.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, int(not junk), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "good1 " * 5000), (None, "good1"), (3, rows[3][1])]
    labels += [(5000, 1, 0), (None, 1, 1), (4, None, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    d, labels = labelled_docs(spark)
    got = quality.select(d, labels).collect()
    assert len(got) == d.count()
    kept = {r["doc_id"]: r["kept"] for r in got}
    held_out = [k for k in range(400) if k % 2]
    assert np.mean([kept[k] == (k % 5 != 0) for k in held_out]) > 0.95
    assert [r["log_weight"] for r in got if r["doc_id"] in (1000, 1001)] == [0.0, 0.0]
    assert sum(r["kept"] for r in quality.select(d, labels, k=17).collect()) in (17, 18)  # rows of one id and text are one draw
    assert not any(r["kept"] for r in quality.select(d, labels, k=0).collect())
    assert all(r["kept"] for r in quality.select(d, labels.limit(0)).collect())
    assert quality.select(d.limit(0), labels).count() == 0
    left = quality.reject(d, labels)
    assert left.columns == d.columns and left.count() == sum(r["doc_id"] is None or kept[r["doc_id"]] for r in got)
    again = quality.select(d.repartition(7), labels).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_quality_against_plain_python(spark):
    """Log ratios and keys of every row, from counts made word by word."""
    import re
    from collections import Counter

    import xxhash

    d, labels = labelled_docs(spark)
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")
    whole = (1 << 64) - 1

    def mixed(x):  # the finaliser of XXH64, by its specification
        x = ((x ^ x >> 33) * 0xC2B2AE3D27D4EB4F) & whole
        x = ((x ^ x >> 29) * 0x165667B19E3779F9) & whole
        return x ^ x >> 32

    def grams(text):
        h = [xxhash.xxh64(w, seed=42).intdigest() for w in word.findall((text or "").encode())]
        pairs = [mixed((a * 3 + mixed(b)) & whole) for a, b in zip(h, h[1:], strict=False)]
        return [x % quality.BUCKETS for x in [*map(mixed, h), *pairs]]

    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    half = {r[0]: r[1] for r in d.select("doc_id", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))).collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"]}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good and half[i] == 0:
            target.update(grams(t))
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values())

    def ratio(b):
        p = (raw[b] + 1) / n
        return np.log((target[b] + quality.PRIOR * p) / (m + quality.PRIOR) / p)

    model = quality.fit(d, labels)
    want = sorted((str(i), float(sum(map(ratio, grams(t))))) for i, t in rows)
    scored = quality.scored(d, model, temperature=2.0).withColumn("u", (F.pmod(F.xxhash64(F.lit("gumbel"), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).collect()
    got = sorted((str(r["id"]), r["log_ratio"]) for r in scored)
    assert [i for i, _ in got] == [i for i, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=2e-5)
    assert all(abs(r["key"] - (r["log_ratio"] / 2 - np.log(-np.log(r["u"])))) < 1e-5 for r in scored)
    drawn = quality.select(d, labels, k=50).collect()
    least = sorted((r["key"] for r in drawn), reverse=True)[49]
    assert all(r["kept"] == (r["key"] >= least) for r in drawn)


def test_reject_decides_by_row(spark):
    d, labels = labelled_docs(spark)
    more = spark.createDataFrame([(6, " ".join(GOOD), "y"), (20, " ".join(GOOD), "y")], d.schema)  # 20 is junk under its other text
    left = quality.reject(d.union(more), labels)
    assert left.columns == d.columns
    assert left.filter("doc_id = 20").select("kept").collect() == [("y",)]


def test_kth_largest(spark):
    keys = [random.choice([1.5, -2.0, 3.25, random.random()]) for _ in range(5000)]
    d = spark.createDataFrame([(v, k) for k, v in enumerate(keys)], "key double, id long")
    order = sorted(((v, k) for k, v in enumerate(keys)), key=lambda x: (-x[0], x[1]))
    for k in (1, 2, 700, 2500, 5000):
        assert quality.kth_largest(d, k) == order[k - 1]
    assert quality.kth_largest(d, 5001) is None


def plain_mix(rows, weights=(3, 1, 2)):
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    named = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(named)}
    cap, left, free, target = {s: 2 * sizes[s] for s in named}, 1.5 * sum(sizes.values()), set(named), {}
    while free:
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if share[s] >= cap[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
        free -= set(over)
    return sizes, target


def test_mixing(spark):
    rows = []
    for k in range(1500):
        s = random.choice(["a", "a", "a", "a", "é", "B", "", "z", None])
        n = random.choice([0, 1, 5, 40, 200])
        rows.append((k, s, n))
    rows += [(2000, "only-empty", 0), (2001, "one", 500), (None, "a", 3)]
    d = spark.createDataFrame([(i, s, " ".join(["w"] * n) if n or i % 2 else None, 9) for i, s, n in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes, target = plain_mix(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - target[s]) <= 0.5 * max(n for _, q, n in rows if q == s) + 1e-6, s
    again = mixing.mix(d.repartition(9)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    clashing = d.withColumns({c: F.lit(c) for c in ("target", "source_size", "copies", "taken", "base", "below", "bucket", "h", "key")})
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and out.count() == sum(r["copies"] for r in got)
    assert {tuple(r) for r in out.select("size", "target", "base", "below").distinct().collect()} == {(9, "target", "base", "below")}
    assert {"base", "below", "h"} <= set(mixing.mix(clashing).columns)
    assert mixing.mix(d.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [r["taken"] for r in mixing.mix(nothing).collect()] == [0, 0]


def test_toxicity(spark):
    d, labels = labelled_docs(spark)
    got = {r["doc_id"]: r for r in toxicity.classify(d, labels).collect()}
    held_out = [k for k in range(400) if k % 2]
    assert np.mean([got[k]["toxic"] == (k % 7 == 0) for k in held_out]) > 0.97
    assert all(0 <= r["severity"] <= toxicity.GRADES for r in got.values())
    mild, strong = spark.createDataFrame([(1, "good1 vile good2 nasty"), (2, "VILE nasty foul vile nasty foul vile nasty")], "doc_id long, text string").collect()
    model = toxicity.fit(d, labels)
    scored = {r["doc_id"]: r["severity"] for r in toxicity.severity(spark.createDataFrame([mild, strong]), model).collect()}
    assert scored[2] > scored[1]
    assert not got[1000]["toxic"] and not got[1001]["toxic"]
    assert {r["severity"] for r in toxicity.classify(d, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(d.limit(0), labels).count() == 0
    # every row's probabilities, word by word
    import re

    import xxhash

    def plain(text):
        tally = {}
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()):
            b = xxhash.xxh64(w, seed=42).intdigest() % toxicity.BUCKETS
            tally[b] = tally.get(b, 0) + 1
        place = {b: k for k, b in enumerate(model.chosen.tolist())}
        x = sum(model.weights[place[b]] * (1 + np.log(n)) for b, n in tally.items() if b in place)
        p = 1 / (1 + np.exp(model.thresholds - x))
        return round(float(p.sum()), 5), int((p >= 0.5).sum())

    texts = {i: t for i, t in d.select("doc_id", "text").collect()}
    for i, r in got.items():
        severity, grade = plain(texts[i])
        assert abs(r["severity"] - severity) < 2e-5 and r["grade"] == grade and r["toxic"] == (grade > 0)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == toxicity.GRADES


def test_grades_come_from_held_out_scores():
    rng = np.random.default_rng(5)
    n, width = 400, 12
    toxic, fold = rng.random(n) < 0.4, rng.integers(0, toxicity.FOLDS, n)
    row = np.repeat(np.arange(n), 3)
    column = np.where(toxic[row], rng.integers(0, 6, 3 * n), rng.integers(4, width, 3 * n))
    x = 1 + np.log(rng.integers(1, 4, 3 * n))
    grade = toxicity._grades(row, column, x, toxic, fold, width)
    assert (grade[~toxic] == 0).all() and set(grade[toxic]) == {1, 2, 3}
    for k in range(toxicity.FOLDS):  # a fold's grades do not move with its own labels' weights
        w, _ = toxicity._regression(row[fold[row] != k], column[fold[row] != k], x[fold[row] != k], toxic.astype(int), width, 1, fold != k)
        score = np.bincount(row, w[column] * x, minlength=n)
        own = (fold == k) & toxic
        assert (grade[own] == 1 + (score[own, None] > np.quantile(score[own], [1 / 3, 2 / 3])).sum(axis=1)).all()


def plain_top(rows, queries, k):
    ok = [(i, [int(np.floor(256 * float(np.float32(v)))) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for q, x in {(i, tuple(x)) for i, x in ok if i in queries}:
        scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in ok if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("n", "spread"), [(3, 1.0), (600, 1.0), (600, 0.05)])
def test_topk(spark, n, spread):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(3, 12))
    rows = [(i, (centre[i % 3] + spread * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(n)]
    if n > 100:
        for k in range(100, 180):
            rows[k] = (k, rows[0][1])
        rows += [(900, None), (901, [float("nan")] * 12), (950, [1.0, None]), (None, [1.0] * 12), (960, [0.5] * 5), (961, [1e7, -1e7])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(6)
    got = topk.search(d, d.filter("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == plain_top(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    assert topk.search(d, d.limit(0)).count() == 0 and topk.search(d.limit(0), d.filter("vec_id = 0")).count() == 0


def test_topk_sends_only_blocks_that_bounds_leave(spark, monkeypatch):
    """Many blocks and groups: of clustered vectors few pairs are sent, and the rows are those of brute force."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = np.random.default_rng(8)
    centres = 4 * rng.normal(size=(12, 16)).round(1)
    rows = [(i, (centres[i % 4] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    sent = []
    plain = topk._scored
    monkeypatch.setattr(topk, "_scored", lambda asked, blocks, pairs, k, tasks: (sent.append((pairs.count(), blocks.count(), asked.count())), plain(asked, blocks, pairs, k, tasks))[1])
    got = topk.search(d, d.filter("vec_id % 10 = 0"))
    assert sorted(map(tuple, got.collect())) == plain_top(rows, set(range(0, 1500, 10)), 5)
    assert sum(n for n, _, _ in sent) < 0.6 * sent[0][1] * sent[0][2], sent


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, x = np.floor(256 * rng.normal(size=(50, 64))), np.floor(256 * rng.normal(size=(80, 64)))
    for s in topk.LEVELS:
        assert (topk.features(q, s) @ topk.features(x, s).T >= q @ x.T - 1e-6).all()


def test_pipeline(spark, data):
    import corpus_pipeline

    docs, before = spark.read.parquet(f"{data}/documents.parquet"), None
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, data))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if k < 2:
            assert 0 < docs.count() <= before.count()
        if k == 3:
            assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert docs.count() == corpus_pipeline.run(spark, data).count() > 0
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, data)
    assert empty.count() == 0
    # clashing names, repeated rows and ids, one very long text
    names = ("size", "target", "base", "below", "n_words", "n_removed", "kept_text", "key", "component_id", "kept", "text_key")
    odd = spark.read.parquet(f"{data}/documents.parquet").withColumns({c: F.lit(c) for c in names})
    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda k: F.concat(F.lit("long"), k.cast("string"))))
    twice = odd.orderBy("doc_id").limit(3)
    odd = odd.union(twice).union(twice.withColumn("text", F.lower("text"))).union(odd.limit(1).withColumns({"doc_id": F.lit(10**9), "text": long}))
    columns = odd.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        odd = corpus_pipeline.staged(stage(spark, odd, data))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert odd.columns == columns and odd.count() > 0
            assert all(odd.filter(F.col(c) != c).isEmpty() for c in names)
        if k in (1, 2):  # one row of each group left
            assert odd.count() == odd.select("doc_id").distinct().count()
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        nulls = corpus_pipeline.staged(stage(spark, nulls, data))
    assert nulls.filter(F.col("n_tokens") != 2).count() == 0
