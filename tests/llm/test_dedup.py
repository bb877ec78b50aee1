"""SimHash (3), substrings (4) and embeddings (10) against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from siltstone.llm import epsilonjoin, nearcopies, rings, simhash, substring, textkit
from siltstone.operators.graph import connected_components

WORD = r"[^\x20\x09-\x0D]+"
random.seed(11)
VOCABULARY = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def edge_rows():
    long = prose(30_000)
    base = prose(400)
    return [
        (1, base), (2, base.upper()), (3, base.replace(" ", "  \n")), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "ONE"), (9, "one two"), (10, long), (11, long + " end"),
        (12, prose(60) + " " + base), (13, base[: len(base) // 2]), (14, "de " * 200), (15, "de " * 120), (16, "\x00 \x1f odd"), (17, "ÀÉ àé"), (17, "ÀÉ àé"), (None, base), (None, None),
    ]


def components(ids, linked):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_xxh64_of_every_length():
    raw = np.frombuffer(random.randbytes(4000), np.uint8)
    starts = np.array([random.randrange(3800) for _ in range(200)])
    ends = starts + np.arange(200)
    want = [xxhash.xxh64(raw[a:b].tobytes(), seed=42).intdigest() for a, b in zip(starts, ends, strict=True)]
    assert textkit.xxh64(raw, starts, ends).tolist() == want


def test_simhash_edges(spark):
    rows = edge_rows()
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = simhash.near_duplicates(d).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for r in got:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] and len(r["fingerprint"]) == 16
    assert simhash.near_duplicates(d.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    left = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(left) == sorted(set(want.values()))  # one row of each group, repeated rows or not


def test_dropping_decides_by_row(spark):
    a, b = prose(90), prose(90)
    rows = [(1, a, "p"), (1, a, "p"), (1, b, "p"), (2, b, "q"), (3, a, "q"), (4, None, "r"), (4, None, "s"), (None, a, "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string")
    for setting in ({}, {"shingle": 5, "similarity": 0.8}):
        kept = [tuple(r) for r in simhash.drop_near_duplicates(d, **setting).collect()]
        # one id makes one group of its texts; nulls are a text as others are
        assert sorted((i, t) for i, t, _ in kept if i is not None and t is not None) == [(1, min(a, b, key=lambda t: spark.sql("SELECT xxhash64(:t) AS h", {"t": t}).first()["h"]))]
        assert [i for i, t, _ in kept if t is None] == [4] and [x for i, _, x in kept if i is None] == ["t"]


@pytest.mark.parametrize("bucket", [32, 1 << 14])
def test_simhash_dense_groups_and_full_buckets(spark, bucket):
    base, prints = random.getrandbits(64), {}
    for k in range(700):
        x = random.getrandbits(64) if random.random() < 0.2 else base
        for b in random.sample(range(64), random.randint(0, 4)):
            x ^= 1 << b
        prints.setdefault(x, k)
    classes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for x, k in prints.items()], "fp long, rep long")
    links = simhash.links(classes, bucket)
    assert links.count() < 60 * len(prints)
    got = dict(connected_components(links).collect())
    by = {k: x for x, k in prints.items()}
    want = components(sorted(by), lambda a, b: (by[a] ^ by[b]).bit_count() <= 2)
    assert {k: got.get(k, k) for k in by} == want


def plain_cut(rows, width):
    words = [(i, re.findall(WORD, t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[s : s + width])] = min(i, first.get(tuple(w[s : s + width]), i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s : s + width])] < i:
                gone[s : s + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("width", "gram"), [(50, 8), (6, 2)])
def test_substring_edges(spark, width, gram):
    passages = [prose(random.randint(40, 180)) for _ in range(8)]
    rows = edge_rows() if width == 50 else [r for r in edge_rows() if r[0] not in (10, 11)]
    for k in range(100, 180):
        parts = []
        for _ in range(random.randint(0, 4)):
            w = random.choice(passages).split()
            a = random.randrange(len(w) // 2)
            w = w[a : a + random.randint(20, 180)]
            if random.random() < 0.3 and w:
                w[random.randrange(len(w))] = "x"
            parts.append(random.choice([" ", "\n", "  "]).join(w))
        rows.append((k, " ".join(parts)))
    d = spark.createDataFrame([(*r, "own", 5) for r in rows], "doc_id long, text string, kept_text string, other int")
    out = substring.dedup_substrings(d, window=width, gram=gram)
    assert out.columns == ["doc_id", "text", "other", "n_words", "n_removed", "kept_text"]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()), key=str)
    assert got == sorted(plain_cut(rows, width), key=str)
    assert any(0 < n < m for _, m, n, _ in got)
    assert substring.dedup_substrings(d.limit(0)).count() == 0


def plain_factors(own, references, window):
    """The greedy parse, by trying every length in every reference at every place."""
    out, at = [], 0
    while at + window <= len(own):
        best = 0
        for ref in references:
            for k in range(len(ref) - window + 1):
                n = 0
                while at + n < len(own) and k + n < len(ref) and own[at + n] == ref[k + n]:
                    n += 1
                best = max(best, n)
        if best >= window:
            out.append((at, at + best))
            at = at + best - window + 1
        else:
            at += 1
    return out


def test_factors_are_those_of_a_greedy_parser():
    rng = random.Random(6)
    for _ in range(300):
        # blocks around one anchor that occurs once in each: words 0 to 2 elsewhere
        def block():
            o = rng.randint(0, 6)
            return [rng.randint(0, 1) for _ in range(o)] + [7, 8] + [rng.randint(0, 1) for _ in range(rng.randint(3, 9))], o

        (own, o), refs = block(), [block() for _ in range(rng.randint(1, 4))]
        # the parse of a block looks at the windows that hold its anchor
        got = substring.factors(np.array(own, np.uint64), o, [(np.array(w, np.uint64), k) for w, k in refs], 5)
        want = [(a, b) for a, b in plain_factors(own, [w for w, _ in refs], 5) if a <= o and b >= o + 2]
        windows = lambda spans: {s for a, b in spans for s in range(a, b - 4) if s <= o and s + 5 >= o + 2}
        plain = {s for s in range(len(own) - 4) if s <= o and s + 5 >= o + 2 and any(own[s : s + 5] == w[k : k + 5] for w, _ in refs for k in range(len(w) - 4))}
        assert windows(got) == plain
        assert {s for s in windows(got)} >= {s for a, b in want for s in range(a, b - 4) if s <= o and s + 5 >= o + 2}
        for a, b in got:  # every factor is one, and none could go further
            assert any(own[a:b] == w[a - o + k : b - o + k] for w, k in refs if a - o + k >= 0)
            assert not any(own[a : b + 1] == w[a - o + k : b + 1 - o + k] for w, k in refs if a - o + k >= 0 and b < len(own))


def test_substring_anchor_with_many_references(spark):
    """A passage in every document: parsed in tasks up to a bound, looked up by windows beyond, with one result."""
    passage = prose(30)
    rows = [(k, f"{prose(random.randint(20, 60))} {passage} {prose(3) if k % 4 else passage} {prose(40)}") for k in range(60)]
    rows += [(100 + k, f"{rows[k][1]} {prose(5)}") for k in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(plain_cut(rows, 12))
    for references in (1, 5, 256):
        got = substring.dedup_substrings(d, window=12, gram=4, references=references).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert sorted(map(tuple, got)) == want


def test_substring_digest(spark):
    rows = [(1, prose(80)), (2, None)]
    got = {r["doc_id"]: r["kept_sha256"] for r in substring.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: hashlib.sha256(rows[0][1].encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_epsilon_join(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6))
    centres = rng.normal(size=(4, 6))
    for k in range(400):
        x[k] = centres[k % 4] * (1 + k % 3) + rng.normal(size=6) * 0.25
    x[500:540] = x[0]
    x[600] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [float("nan")] * 6), (5002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5003, []), (5004, [float("inf"), 1.0]), (None, None)]
    d = spark.createDataFrame([(*r, 7) for r in rows + odd], "vec_id long, embedding array<double>, kept int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in epsilonjoin.near_duplicates(d).collect()}
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(all="ignore"):
        linked = x @ x.T / norm[:, None] / norm[None, :] >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[linked[i]].min(initial=10**9)) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert {i: got[i] for i in range(len(x))} == {i: (int(linked[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))}
    assert all(got[i] == (0, i, True) for i, _ in odd if i is not None)
    # vectors of rows without an id link like others, and join what they lie between
    flat = lambda d: [float(np.cos(np.deg2rad(d))), float(np.sin(np.deg2rad(d)))]
    few = spark.createDataFrame([(1, flat(0)), (None, flat(20)), (3, flat(40)), (4, flat(170)), (4, flat(90)), (None, flat(300))], "vec_id long, embedding array<double>")
    assert sorted(map(str, (tuple(r) for r in epsilonjoin.near_duplicates(few).collect()))) == sorted(
        map(str, [(1, 1, 1, True), (None, 2, 1, None), (3, 1, 1, False), (4, 0, 4, True), (4, 0, 4, True), (None, 0, None, None)])
    )
    monkeypatch.setattr(epsilonjoin, "INTERVAL_BYTES", 2_000)  # many intervals and tiles
    again = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in epsilonjoin.near_duplicates(d).collect()}
    assert again == got
    assert epsilonjoin.near_duplicates(d.limit(0)).count() == 0


def run_sets(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, text)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_finds_edited_copies(spark, monkeypatch):
    """Planted copies of 0.8 and more go; op3's contract setting left nearly all of them."""
    import corpus_pipeline

    rng, rows = random.Random(4), edge_rows()
    for k in range(100, 130):
        base = prose(rng.randint(60, 400)).split()
        rows.append((k, " ".join(base)))
        for j in range(1, 5):
            edited = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) * j // 70)):
                edited[at] = f"edit{k}x{at}"
            rows.append((1000 * j + k, " ".join(edited)))
    # copies of each other only around a text that is not the first of them
    hub = prose(300).split()
    for j in range(12):
        edited = list(hub)
        for at in rng.sample(range(300), 6):
            edited[at] = f"spoke{j}x{at}"
        rows.append((6000 + j, " ".join(edited)))
    rows.append((7000, " ".join(hub)))
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(run_sets(t))

    def linked(a, b):
        return any(x == y or 10 * len(x & y) >= 8 * len(x | y) for x in sets[a] for y in sets[b])

    want = components(sorted(sets), linked)
    assert sum(i != root for i, root in want.items() if i >= 100) > 50
    for rows_, hashes in ((8, 1 << 18), (256, 1 << 18), (64, 1_000)):  # several blocks to a group, or one
        monkeypatch.setattr(nearcopies, "BLOCK_ROWS", rows_)
        monkeypatch.setattr(nearcopies, "BLOCK_HASHES", hashes)
        kept = corpus_pipeline.near_dedup(spark, d, "")
        assert kept.columns == d.columns
        got = kept.collect()
        assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(set(want.values()))
        assert sum(r["doc_id"] is None for r in got) == 2
    assert corpus_pipeline.near_dedup(spark, d.limit(0), "").count() == 0


def test_ring_fingerprints_are_simhashes_of_sets():
    """The first word is the SimHash of the set of runs, whatever its size; further words differ from it."""
    texts = [prose(400), None, "one", prose(9), "", prose(3000), prose(259), prose(260)]
    got = rings.fingerprints(
        np.array([v for t in texts for v in sorted(xxhash.xxh64(g.encode(), seed=42).intdigest() for g in run_sets(t))], np.uint64),
        np.array([len(run_sets(t)) for t in texts]),
    )
    for t, row in zip(texts, got, strict=True):
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in run_sets(t)]
        assert int(row[0]) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
        assert len(set(row.tolist())) == (rings.WORDS if h else 1)


@pytest.mark.parametrize(("rows", "bucket"), [(1 << 23, 1 << 14), (1 << 23, 3), (60, 1 << 14), (1, 1 << 14)])
def test_ring_proposes_every_near_copy(spark, monkeypatch, rows, bucket):
    """Pairs at 0.8 or just above, of four runs and more, lie in a group; keys of 12 to 17 bits, buckets held or handed on whole."""
    monkeypatch.setattr(rings, "ROWS", rows)
    monkeypatch.setattr(rings, "BUCKET", bucket)
    rng, sets, pairs = np.random.default_rng(5), [], []
    for k in range(400):
        size = 5 if k % 4 == 0 else int(rng.integers(5, 600))
        union = rng.integers(0, 1 << 64, size, np.uint64)
        gone = size // 5
        cut = int(rng.integers(0, gone + 1))
        pairs.append((2 * k, 2 * k + 1))
        sets += [union[cut:], np.concatenate([union[:cut], union[gone:]])]
    size = np.array([len(s) for s in sets])
    prints = rings.fingerprints(np.concatenate(sets), size).view(np.int64)
    classes = spark.createDataFrame([(i, int(n), p.tolist()) for i, (n, p) in enumerate(zip(size, prints, strict=True))], "rep long, n long, prints array<long>")
    by: dict = {}
    for r in rings.groups(classes).collect():
        by.setdefault(r["key"], []).append(r)
    proposed = set()
    for group in by.values():
        reps = sorted(r["rep"] for r in group)
        assert len(set(reps)) == len(reps) and {r["first"] for r in group} == {reps[0]} and all(r["n"] == size[r["rep"]] for r in group)
        proposed |= {(a, b) for a in reps for b in reps if a < b}
    assert all(p in proposed for p in pairs)
    if bucket > 3:
        assert len(proposed) < 1.5 * len(pairs)


def test_stage_takes_its_candidates_from_the_ring(spark, monkeypatch):
    """The stage's near copies come through fingerprints and chains, by no path beside them."""
    import corpus_pipeline

    base = prose(200)
    d = spark.createDataFrame([(1, base), (2, base.upper().replace("É", "é")), (3, base + " end"), (4, prose(200))], "doc_id long, text string")
    left = lambda: sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, d, "").collect())
    assert left() == [1, 4]
    found = rings.groups
    monkeypatch.setattr(rings, "groups", lambda *a: found(*a).filter("false"))
    assert left() == [1, 3, 4]
    with pytest.raises(ValueError, match="0.8"):
        simhash.drop_near_duplicates(d, shingle=5, similarity=0.5)


def test_stage_keeps_rows_few_in_a_large_group(spark, monkeypatch):
    """One large group of near copies, some linked and some not: a member is paired once, and buckets of the same blocks meet once."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(160)]
    rows = [(1000, " ".join(base))]
    for j in range(360):
        edited = list(base)
        for at in rng.sample(range(160), j % 9):
            edited[at] = f"edit{j}x{at}"
        rows.append((j, " ".join(edited)))
    sets = {i: run_sets(t) for i, t in rows}
    want = components(sorted(sets), lambda a, b: sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))
    assert 100 < len(set(want.values())) < 240  # the rest is one group

    import corpus_pipeline

    staged, similar, seen = nearcopies.staged, nearcopies._similar, {}

    def counted(df, name="stage"):
        out = staged(df, name)
        seen[name] = out.count()
        return out

    def paired(pairs, *rest):
        seen["pairs"] = pairs.count()
        return similar(pairs, *rest)

    monkeypatch.setattr(nearcopies, "staged", counted)
    monkeypatch.setattr(nearcopies, "_similar", paired)
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 32)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, d, "").collect()) == sorted(set(want.values()))
    assert seen["pairs"] <= seen["nodes"]
    assert seen["open"] < seen["members"] and seen["few"] < seen["sides"]


def test_tiles_are_those_of_all_buckets(spark):
    """Buckets of the same blocks are one; blocks of one large component do not meet."""
    rng = random.Random(9)
    pure = {b: (b % 3 if b < 9 else None) for b in range(16)}
    held = {k: rng.sample(range(16), rng.randint(1, 3)) if k % 2 else [1, 2, 5, 9, 12] for k in range(80)}
    sides = spark.createDataFrame([(k, b, pure[b]) for k, bs in held.items() for b in bs], "key long, block long, pure long")
    want = {(a, b) for bs in held.values() for a in bs for b in bs if a <= b and (pure[a] is None or pure[a] != pure[b])}
    got = [tuple(r) for r in nearcopies._tiles(sides).collect()]
    assert len(got) == len(set(got)) and set(got) == want
