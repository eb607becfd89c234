"""Jaccard components, substring removal, decontamination and exact search against brute force."""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest

from rillflow.llm import common, decontamination, jaccard, queries, substrings, topk

WORDS = [f"w{i}" for i in range(60)]
CLASHING = "doc_id long, text string, n long, key string, node long, found string, label int"


def frame(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, 1, "k", 2, "f", 3) for i, t in zip(ids, texts)], CLASHING)


def near_copies(seed: int, groups: int = 6, size: int = 7) -> list:
    rng = random.Random(seed)
    out: list = [None, "", "   \n\t ", "one", "one", "One two", "one  two", "a b c", "A b\tc", "x " * 5000]
    for _ in range(groups):
        base = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(8, 220))]
        out.append(" ".join(base))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def brute_components(texts: list, width: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed,width,num,max_bits", [(1, 3, 90, 28), (2, 5, 80, 28), (2, 5, 80, 0)])
def test_components_equal_brute_force(spark, seed, width, num, max_bits):
    texts = near_copies(seed)
    got = {r[0]: (r[1], r[2]) for r in jaccard.similar_sets(frame(spark, texts), width=width, num=num, den=100, max_bits=max_bits).collect()}
    assert got == brute_components(texts, width, num, 100)


@pytest.mark.parametrize("stars", [0, 2])
def test_groups_larger_than_a_page(spark, stars, monkeypatch):
    # without stars every link comes by the tree: all pairs that are verified are its own
    monkeypatch.setattr(jaccard, "PAGE", 32)
    monkeypatch.setattr(jaccard, "LOT", 100)
    monkeypatch.setattr(jaccard, "STAR", 1)
    texts = near_copies(3, groups=3, size=110)
    got = {r[0]: (r[1], r[2]) for r in jaccard.similar_sets(frame(spark, texts), width=3, num=90, den=100, stars=stars).collect()}
    want = brute_components(texts, 3, 90, 100)
    assert got == want and max(Counter(c for _, c in want.values()).values()) > 64


def test_a_failing_pair_does_not_hide_a_link_of_its_label(spark):
    rng = np.random.default_rng(3)
    j = np.unique(rng.integers(0, 2**63, 100, dtype=np.int64).view(np.uint64))
    i = j ^ np.uint64(1)  # the very same counts, no shingle in common
    sets = {10: i, 20: j[:-1], 30: j}  # 20 and 30 link; 10 and 20 have one label, as by links to sets elsewhere
    label = {10: 10, 20: 10, 30: 30}
    units = spark.createDataFrame([(1, 0, 0, 0, k, label[k], len(x), bytearray(jaccard.counts_of(x))) for k, x in sets.items()], "key long, page long, u long, v long, node long, label long, n long, counts binary")
    members = jaccard.tree_members(units, 90, 100)
    assert {r["node"] for r in members.collect()} == {10, 20, 30}
    found = spark.createDataFrame([(k, bytearray(x.astype("<u8").tobytes())) for k, x in sets.items()], "node long, found binary")
    assert {tuple(r) for r in jaccard.tree_links(members, found, 90, 100).collect()} == {(20, 30)}


def test_spread_bounds_lose_no_link_and_open_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAGE", 16)
    rng = np.random.default_rng(12)
    fresh = lambda k: rng.integers(0, 2**63, k, dtype=np.int64).view(np.uint64)
    base, some, sets = np.unique(fresh(100)), fresh(40), {}
    for i in range(160):  # near the base, too far from all others, and far ones that link each other by what they add
        k = int(rng.integers(0, 5) if i % 2 else rng.integers(6, 12))
        sets[i] = np.unique(np.r_[rng.permutation(base)[k:], some[:k] if i % 20 == 0 else fresh(k)])
    sets[160] = np.unique(np.r_[base, sets[0][-3:]])  # holds the base and more
    links = {(a, b) for a in sets for b in range(a) for w in [len(np.intersect1d(sets[a], sets[b], assume_unique=True))] if 190 * w >= 90 * (len(sets[a]) + len(sets[b]))}
    large = spark.createDataFrame([(0, i, len(sets)) for i in sets], "key long, node long, m long")
    table = spark.createDataFrame([(i, bytearray(x.astype("<u8").tobytes())) for i, x in sets.items()], "node long, found binary")
    for max_bits in (28, 5):
        got = jaccard.spread(large, table, 90, 100, max_bits)
        of = {x["node"]: x for x in got.collect()}
        assert set(of) == set(sets) and all(of[a]["r"] <= of[b]["p"] and of[b]["r"] <= of[a]["p"] for a, b in links)
        z = of[0]["z"]
        assert all(tuple(sorted((i, z), reverse=True)) in links for i in of if i != z and not of[i]["far"])
        points = spark.createDataFrame([(i, len(x), bytearray(jaccard.counts_of(x))) for i, x in sets.items()], "node long, n long, counts binary")
        if max_bits == 28:
            near = jaccard.components(got.where("not far and node <> z").selectExpr("z as a", "node as b"))
            rows = {k: jaccard.tree_units(large, points, near, 90, 100, *k).count() for k in ((), (got,))}
            members = jaccard.tree_members(jaccard.tree_units(large, points, near, 90, 100, got), 90, 100)
            joined = jaccard.joined(near, jaccard.keep(jaccard.tree_links(members, table, 90, 100), "links"))
            label = {x["node"]: x["label"] for x in joined.collect()}
            assert all(label[a] == label[b] for a, b in links) and rows[(got,)] < rows[()] / 2


def test_copies_bring_one_set(spark):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(3000)] + [(5000 + i, f"t{i} b c d") for i in range(3000)], "doc_id long, text string")
    hasher = jaccard.Hasher()
    nodes = [(i, jaccard.node_of(jaccard.shingle_set(hasher, t.encode(), 3))) for i, t in [(0, "a b c d")] + [(5000 + k, f"t{k} b c d") for k in range(3000)]]
    ids = spark.createDataFrame(nodes, "doc_id long, node long")
    for max_bits in (28, 0):
        assert jaccard.shingle_table(docs, ids, 3, max_bits, False).count() == len(nodes)


def test_bit_arrays_run_no_job_for_each_partition(spark):
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    cells = spark.range(3000).selectExpr("xxhash64(id) AS at")
    want = np.unique(np.array([r[0] for r in cells.collect()]) & ((1 << 20) - 1))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("bits", "bit array")
        got = common.bit_array(cells, 20)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert np.array_equal(np.flatnonzero(np.unpackbits(got.view(np.uint8), bitorder="little")), want)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("bits")) <= 10


def test_tree_finds_every_pair_and_opens_few():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**63, 120, dtype=np.int64).view(np.uint64)) for _ in range(300)]
    for i in range(0, 300, 3):  # each third set is a near copy of its neighbour
        sets[i] = np.unique(np.r_[sets[i + 1][:115], sets[i][:5]])
    n = np.array([len(s) for s in sets])
    points = np.stack([np.bincount((s >> np.uint64(56)).astype(int), minlength=256) for s in sets])
    tree = jaccard.CountTree(n, points)
    assert len(tree.levels) == 4
    r, c = jaccard.tree_join(tree, tree, 80, 100)
    found = set(zip(r.tolist(), c.tolist()))
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    assert found == {(i, j) for i, j in zip(*np.nonzero(180 * bound >= 80 * (n[:, None] + n[None])))}
    assert {(i, i + 1) for i in range(0, 300, 3)} <= found and len(found) < 1000


def test_key_lists_lose_no_pair():
    rng = np.random.default_rng(4)

    def named(found: np.ndarray, num: int, unique: set) -> set:
        lists = jaccard.key_lists(found, num, 100)
        keys = np.concatenate([k for _, k in lists]).view(np.int64)
        # any order of the whole corpus will do, if only contents that no other set has come first
        level = np.array([0 if k in unique else 1 + (k >> 7) % 2 for k in keys.tolist()])
        good = jaccard.rarest(keys, level, np.array([len(k) for _, k in lists]), np.array([t for t, _ in lists]))
        return set(keys[good].tolist())

    for n in [*range(1, 40), 60, 100, 333, 1000]:
        for num in (80, 90):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64))
            most = max(k for k in range(n + 1) if 100 * (n - k) >= num * (n + k))  # replace k of n shingles
            for k in {0, most // 2, most}:
                y = np.unique(np.concatenate([x[rng.permutation(n)][: n - k], rng.integers(0, 2**63, k, dtype=np.int64).view(np.uint64)]))
                own, other = (set(np.concatenate([k for _, k in jaccard.key_lists(s, num, 100)]).view(np.int64).tolist()) for s in (x, y))
                assert named(x, num, own - other) & named(y, num, other - own)


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(5)
    n = np.array([30, 500, 2000])
    grids = [32, 128, 512]
    sets = [np.unique(rng.integers(0, 2**63, k, dtype=np.int64).view(np.uint64) * np.uint64(2)) for k in n]
    counts = [np.minimum(np.bincount((s >> np.uint64(65 - g.bit_length())).astype(int), minlength=g), 255).astype(np.uint8).tobytes() for s, g in zip(sets, grids)]
    for i in range(3):
        for j in range(3):
            g = min(grids[i], grids[j])
            p = jaccard.points_of([counts[i], counts[j]], n[[i, j]], g)
            assert np.minimum(p[0], p[1]).sum() >= len(np.intersect1d(sets[i], sets[j]))


def test_one_of_each_keeps_columns_nulls_and_single_rows(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "other words here now ok", None, "a b c d e f"], [3, 2, 5, 7, 2])
    kept = jaccard.one_of_each(docs, width=5, num=80, den=100)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == [2, 5, 7]
    assert jaccard.one_of_each(docs.limit(0), width=5, num=80, den=100).count() == 0


def test_one_of_each_decides_text_by_text(spark):
    copied, other = "a b c d e f g", "an unrelated text of seven words here"
    docs = frame(spark, [copied, copied, other, "A b c d e f g", None, None], [1, 2, 2, 2, 4, 4])
    got = sorted((r[0], r[1]) for r in jaccard.one_of_each(docs, width=5, num=80, den=100).select("doc_id", "text").collect() if r[1])
    assert got == [(1, copied), (2, other)]
    nulls = frame(spark, [copied, copied], [None, None])
    assert jaccard.one_of_each(nulls, width=5, num=80, den=100).count() == 2


def test_null_ids_link_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.similar_sets(docs).collect()), key=repr)
    assert got == [(1, 2, 1), (None, 0, None), (None, 2, None)]


def brute_removal(texts: dict[int, str | None], width: int) -> dict[int, tuple[int, int, str]]:
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first: dict = {}
    for i in sorted(words):
        for a in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][a : a + width]), (i, a))
    out = {}
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] != (i, a):
                gone |= set(range(a, a + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("max_bits", [28, 0])
@pytest.mark.parametrize("width", [20, 5])
def test_substrings_equal_brute_force(spark, max_bits, width):
    rng = random.Random(width)
    passage = " ".join(rng.choice(WORDS) for _ in range(45))
    texts: dict = {0: None, 1: "", 2: "one two", 3: "z " * 300, 4: "p q " * 60}
    for i in range(5, 40):
        body = [rng.choice(WORDS) for _ in range(rng.randrange(1, 90))]
        at = rng.randrange(len(body))
        texts[i] = " ".join(body[:at]) + (f" {passage} " if i % 3 else "\n") + " ".join(body[at:])
    texts[40] = texts[8]
    docs = frame(spark, list(texts.values()), list(texts)).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in substrings.remove_repeats(docs, width=width, max_bits=max_bits).collect()}
    assert got == brute_removal(texts, width)


def test_substrings_defined_cases(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    got = sorted(map(tuple, substrings.remove_repeats(docs, texts=True).collect()), key=repr)
    assert [r[:3] for r in got] == [(1, 30, 30), (1, 30, 30), (None, 30, 0)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_substrings_of_differing_texts_of_one_id(spark):
    a, x = " ".join(f"a{i}" for i in range(30)), " ".join(f"x{i}" for i in range(30))
    for max_bits in (28, 0):
        docs = spark.createDataFrame([(1, a), (2, x), (2, a), (3, x)], "doc_id long, text string")
        got = sorted(map(tuple, substrings.remove_repeats(docs, texts=True, max_bits=max_bits).select("doc_id", "n_removed", "kept").collect()))
        assert got == [(1, 0, a), (2, 0, x), (2, 30, ""), (3, 30, "")]


def test_count_min_never_underestimates():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(400)).encode() for _ in range(30)]
    texts += [b" ".join(t.split()[50:120]) for t in texts[:10]]
    hasher, bits = substrings.Hasher(), 12  # far too few columns: most estimates are too high
    whole = substrings.Chunk(hasher, texts, 20, bits)
    cells, n = np.unique(whole.cells(), return_counts=True)
    counts = np.zeros(substrings.ROWS << bits, int)
    counts[cells] = n
    seen = Counter(tuple(w[i : i + 20]) for w in whole.words for i in range(len(w) - 19))
    at = np.nonzero(whole.whole)[0]
    estimate = np.minimum(*(counts[substrings.cell_of(whole.anchor[at], r, bits)] for r in range(2)))
    flat = [w for ws in whole.words for w in ws]
    true = np.array([seen[tuple(flat[i : i + 20])] for i in at])
    assert (estimate >= true).all() and len(set(substrings.cell_of(whole.anchor[at], 0, bits).tolist()) & set(substrings.cell_of(whole.anchor[at], 1, bits).tolist())) == 0
    print("mean and largest overestimate:", (estimate - true).mean(), (estimate - true).max())


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 60)))) for i in range(30)] + [(30, None), (31, "..."), (0, None)]
    texts = []
    for i in range(40):
        filler = [rng.choice(WORDS) for _ in range(rng.randrange(0, 2000))]
        w = items[i % 30][1].upper().split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        texts.append(", ".join(filler[:50]) + " " + " ".join(w) + " " + " ".join(filler[50:]))
    texts += [None, "", "w1"]
    grams = lambda t, n: {tuple(w[i : i + n]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - n + 1) if w}
    want = set()
    for d, t in enumerate(texts):
        for i, q in items:
            n = min(5, len(re.findall(r"[^\W_]+", q or "")))
            own = grams(q, n) if n else set()
            shared = len(own & grams(t, n)) if n else 0
            if own and shared >= 0.8 * len(own) - 1e-9:
                want.add((d, i, len(own), shared))
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    for block in (16_000_000, 300):
        got = decontamination.contained_items(frame(spark, texts), bench, block_chars=block)
        assert {tuple(r)[:4] for r in got.collect()} == want
    left = decontamination.drop_contaminated(frame(spark, texts), bench)
    assert {r[0] for r in left.collect()} == set(range(len(texts))) - {d for d, *_ in want}
    assert decontamination.contained_items(frame(spark, texts), bench.limit(0)).count() == 0


def test_containment_index_is_small_and_its_filter_loses_no_shingle():
    """Each Python worker holds one: 32 MB of marks, whatever the items, made the pipeline's executors too large."""
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(1, 80)))) for i in range(200)]
    index = decontamination.ContainmentIndex(items, 5, 0.8)
    assert len(pickle.dumps(index)) < 2 << 20
    every = np.concatenate([p.hashes for p in index.partitions])
    assert index.filter(every).all()
    others = common.mix(np.arange(100_000, dtype=np.uint64))
    assert index.filter(others).mean() < 0.01
    assert all(i in {x for x, *_ in index.matches(index.shingles_of(common.Hasher(), text))} for i, text in items)


def test_executors_collect_their_garbage_between_stages(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    before = full()
    common.give_back(spark)
    assert full() >= before + spark.sparkContext.defaultParallelism


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 24)).astype(np.float32)
    x[100:110] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 24), (1003, [float("inf")] * 24), (50, [1e30] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = set()
    for a in range(0, 400, 50):
        found = sorted(((int(-(q[a] @ q[b])), b) for b in range(400) if b != a))[:5]
        want |= {(a, r + 1, b, -s) for r, (s, b) in enumerate(found)}
    asked = vectors.where("vec_id % 50 = 0 and (vec_id <> 50 or size(embedding) = 24)")
    for block in (4096, 3):
        assert {tuple(r) for r in topk.top_k(vectors.where("vec_id <> 50 or size(embedding) = 24"), asked, query_block=block).collect()} == want
    assert topk.top_k(vectors, vectors.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0, 4.0]), (1, [1e30, -1e30])], "vec_id long, embedding array<double>")
    assert {(r[0], r[1], r[2]) for r in topk.top_k(few, few.where("vec_id % 50 = 0")).collect()} == {(0, 1, 50), (50, 1, 0), (0, 2, 1), (50, 2, 1)}


def test_top_k_of_large_components_repeated_rows_and_clashing_columns(spark):
    rows = [(0, [2.0**40, 1.0], 1, 2), (50, [2.0**39, 3.0], 1, 2), (1, [2.0**41, -5.0], 1, 2), (1, [2.0**41, -5.0], 1, 2), (2, [0.0, 1.0], 1, 2), (3, [], 1, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v long, score long")
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=3).collect()}
    q = {i: [int(256 * e) for e in v] for i, v, *_ in rows}
    exact = lambda a, b: min(2**63 - 1, sum(x * y for x, y in zip(q[a], q[b])))
    assert got == {(0, 1, 1, exact(0, 1)), (0, 2, 1, exact(0, 1)), (0, 3, 50, exact(0, 50)), (50, 1, 0, exact(50, 0)), (50, 2, 1, exact(50, 1)), (50, 3, 1, exact(50, 1))}


def test_bounds_spare_pairs_of_smooth_vectors():
    rng = np.random.default_rng(6)
    x = np.floor(40 * np.cumsum(rng.standard_normal((3000, 64)), axis=1))
    best = topk.Best(np.arange(0, 3000, 50), x[::50], 5, (2, 4))
    for a in range(0, 3000, 500):
        best.add(np.arange(a, a + 500), x[a : a + 500])
    want = {(q, i) for q in range(0, 3000, 50) for _, i in sorted((-int(x[q] @ x[i]), i) for i in range(3000) if i != q)[:5]}
    assert {(q, i) for q, i, _ in best.rows()} == want
    print("pairs at each level and scored:", best.met)
    assert best.met[-1] < best.met[0] / 2


@pytest.mark.parametrize("name", ["op4_jaccard", "op7_substrings", "op9_topk", "op10_decontamination", "op2_warc"])
def test_registered_queries_equal_their_sql(spark, duck, name):
    from tests.conftest import SF, same

    df = queries.QUERIES[name](spark, SF)
    same([tuple(r) for r in df.collect()], df.columns, duck.execute(queries.ORACLES[name]))
