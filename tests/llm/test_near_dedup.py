import random

import numpy as np
import pytest

from voltide.llm import components, near_dedup


def brute(texts, percent=85):
    """texts: (doc_id, text); component ids by comparing all pairs."""
    sets = []
    for _, t in texts:
        w = "".join(x.lower() if x.isascii() else x for x in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(texts)]


def corpus(rng, groups, copies, size=80):
    vocab = [f"w{i}" for i in range(400)] + ["Éa", "éa", "a\xa0b"]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, size))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w) if rng.random() < 0.5 else "\n".join(w).upper().replace("É", "é" if rng.random() < 0 else "É"))
    rng.shuffle(out)
    return out


def run(spark, rows, percent=85):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, Bank string")
    out = near_dedup.near_duplicates(df, percent=percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in out], key=str)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [*corpus(rng, 40, 6), "", None, " \t", "One two", "one  TWO", "one two three"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "alone here"), (3, texts[3]), (3, texts[3])]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "HUBS", 2)
    monkeypatch.setattr(near_dedup, "DEPTH", 1)
    rng = random.Random(9)
    rows = list(enumerate(corpus(rng, 2, 90, 70) + corpus(rng, 10, 3)))
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_deduplicate(spark):
    rng = random.Random(10)
    texts = corpus(rng, 15, 4)
    rows = [(d, t, d * 2) for d, t in enumerate(texts)] + [(0, texts[0], 0), (None, "null ids alone", 1), (None, texts[1], 2), (500, "", 3), (501, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Text_Hash long")
    out = near_dedup.deduplicate(df, percent=85)
    assert out.columns == df.columns
    want = {d for d, _, c in brute([r[:2] for r in rows]) if d is not None and d == c}
    got = [r.doc_id for r in out.collect()]
    assert sorted(d for d in got if d is not None) == sorted(want)
    assert got.count(None) == 1
    assert near_dedup.deduplicate(df.limit(0)).count() == 0


def test_linked_forest_connects_like_all_links():
    rng = random.Random(1)
    for _ in range(50):
        sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(20, 60))], np.uint64)) for _ in range(12)]
        vs = [bytes([i]) for i in range(12)]
        forest = near_dedup.linked_forest(vs, sets, 60)
        full = [(a, b) for a in range(12) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))]
        root = list(range(12))
        for a, b in full:
            root = [root[b] if r == root[a] else r for r in root]
        part = list(range(12))
        for a, b in forest:
            part = [part[b[0]] if r == part[a[0]] else r for r in part]
        assert [[x == y for y in root] for x in root] == [[x == y for y in part] for x in part]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9)], [(i, i + 1) for i in range(40)], [(7, i) for i in range(30)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in edges:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def below(keys, bank, steps):
    """Sets of the nodes that each row of a bank goes to."""
    rows, found = near_dedup.children(keys, bank, steps)
    out = [set() for _ in keys]
    for r, k in zip(rows.tolist(), found.tolist(), strict=True):
        out[r].add(k)
    return out


@pytest.mark.parametrize("steps", [2, 3])
def test_pairs_meet_below_skipped_levels(steps):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 32, (2000, near_dedup.BANK), np.uint32)
    b = np.where(rng.random(a.shape) < 0.85, a, a + np.uint32(1))
    keys = rng.integers(0, 1 << 63, 2000, np.uint64)
    met = [bool(x & y) for x, y in zip(below(keys, a, steps), below(keys, b, steps), strict=True)]
    assert abs(np.mean(met) - near_dedup.meeting(0.85, steps) / 0.85) < 0.02


def test_jumps_end_where_single_levels_do():
    bank = np.random.default_rng(6).integers(0, 1 << 32, (1, near_dedup.BANK), np.uint32)
    one = np.array([7], np.uint64)
    for _ in range(6):
        one = near_dedup.children(one, np.repeat(bank, len(one), axis=0))[1]
    assert len(one) > 1 and set(one.tolist()) == below(np.array([7], np.uint64), bank, 6)[0]


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_stated_recall_holds_at_the_last_level(threshold):
    rng = np.random.default_rng(7)
    trees, missed, pairs = near_dedup.trees_for(threshold, 0.9999), 0, 3000
    a = rng.integers(0, 1 << 32, (pairs, near_dedup.BANK), np.uint32)
    b = np.where(rng.random(a.shape) < threshold, a, a + np.uint32(1))
    ra, rb = near_dedup.roots(a, trees), near_dedup.roots(b, trees)
    met = np.zeros(pairs, bool)
    for t in range(trees):
        same = np.flatnonzero(ra[:, t] == rb[:, t])
        x, y = below(ra[same, t], a[same], near_dedup.DEPTH), below(rb[same, t], b[same], near_dedup.DEPTH)
        met[same] |= [bool(i & j) for i, j in zip(x, y, strict=True)]
    assert (~met).sum() <= 3


def test_packed_sketches_keep_the_bank():
    m = np.random.default_rng(8).integers(0, 1 << 32, (5, near_dedup.SKETCH), np.uint32)
    assert (near_dedup.banks([near_dedup.pack_sketch(x) for x in m]) == m[:, : near_dedup.BANK]).all()


@pytest.mark.parametrize("percent", [80, 85])
def test_prefixes_lose_no_link(percent):
    rng = np.random.default_rng(9)
    ranks = rng.integers(0, 9, near_dedup.SLOTS, np.uint8)
    for _ in range(400):
        pool = np.unique(rng.integers(0, 1 << 63, 60, np.uint64))
        a = np.sort(rng.choice(pool, rng.integers(1, 55), replace=False))
        b = np.sort(np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 63, rng.integers(1, 5), np.uint64)])))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            (ta, ma), (tb, mb) = near_dedup.prefix(a, ranks, percent), near_dedup.prefix(b, ranks, percent)
            met = set(ta[ma >= len(b)].tolist()) & set(tb[mb >= len(a)].tolist())
            assert met


def test_lists_of_long_texts_are_cut_by_bytes():
    vs, sizes = [bytes([i]) for i in range(9)], [10, 500, 20, 30, 40, 600, 10, 10, 300]
    lists = near_dedup.within_bytes(vs, sizes, 2000)
    size = dict(zip(vs, sizes, strict=True))
    assert all(any(a in x and b in x for x in lists) for a in vs for b in vs)
    assert all(8 * sum(map(size.get, x)) <= 2000 or len(x) == 2 or max(map(size.get, x)) > 125 for x in lists)
    assert near_dedup.within_bytes(vs, sizes, 1 << 20) == [vs]


def test_alike_but_unlinked_members_make_few_comparisons(spark, monkeypatch):
    """One passage in every text, none linked: a node that no level parts."""
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    rng, seen, plain = random.Random(11), [], near_dedup._refine
    monkeypatch.setattr(near_dedup, "_refine", lambda lists, *a: seen.append(sum(len(r.list) for r in lists.collect())) or plain(lists, *a))
    passage = [f"p{i}" for i in range(170)]
    rows = [(d, " ".join(passage + [f"u{d}x{i}" for i in range(28)])) for d in range(600)]
    rows += [(d + 600, t.replace("x27", "x28")) for d, t in rows[:5]]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert len(seen) == 2  # the blocks and the completion
    assert seen[1] < 5 * len(rows)
    assert rng


def test_chains_through_stuck_nodes(spark, monkeypatch, percent=80):
    """Near copies that drift: links run along the chain, not to its hubs."""
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "DEPTH", 1)
    rng = random.Random(12)
    now, rows = [f"w{i}" for i in range(150)], []
    for d in range(200):
        now = list(now)
        for _ in range(rng.choice([1, 2, 2, 3])):
            now[rng.randrange(150)] = f"n{rng.random()}"
        rows.append((d, " ".join(now)))
    rng.shuffle(rows)
    assert run(spark, rows, percent) == sorted(brute(rows, percent), key=str)


def test_very_long_and_clashing(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "a", 1), (2, long + " end", "b", 2), (3, "", "c", 3)], "doc_id long, text string, Gone_ID string, class int")
    out = near_dedup.deduplicate(df.withColumnsRenamed({"class": "gone_text"}))
    assert [r.doc_id for r in out.orderBy("doc_id").collect()] == [1, 3]
    assert out.columns == ["doc_id", "text", "Gone_ID", "gone_text"]
