import hashlib
import random
import re

from voltide.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def brute(text, items, k=13):
    w = WORD.findall(lower(text))
    hit, ids = set(), set()
    for i, t in items:
        x = WORD.findall(lower(t))
        n = min(k, len(x))
        for a in range(len(x) - n + 1) if n else ():
            for b in range(len(w) - n + 1):
                if w[b : b + n] == x[a : a + n]:
                    hit.update(range(b, b + n))
                    ids.add(str(i) if i is not None else "")
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases(rng, n_items, n_docs):
    vocab = ["a", "b", "c", "Éa", "éa", "x9", "D"]
    say = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i if i else None, say(rng.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(n_items)]
    items.append((3, None))
    docs = []
    for _ in range(n_docs):
        parts = [say(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [" ".join(w[a : a + rng.randrange(1, 40)]), say(rng.randrange(9))]
        docs.append(" ".join(parts))
    return items, [*docs, None, "", "..."]


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    for lengths, shard in ((12, 60_000), (12, 50), (3, 60_000)):
        monkeypatch.setattr(d, "SHARD_WORDS", shard)
        items, docs = cases(rng, lengths, 40)
        if lengths == 3:
            items = [(7, " ".join(f"w{j % 11}" for j in range(60))), (8, "q " * 20)]
            docs = [" ".join(["z"] * 5 + [f"w{j % 11}" for j in range(a, a + n)] + ["q"] * n) for a in range(9) for n in (5, 12, 13, 20)] + docs
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        for r in d.contamination(df, bench).collect():
            want = brute(docs[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, docs[r.doc_id]


def test_clean(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [("drop " + item, 1), ("keep " * 500 + item, 2), (None, 3), ("fine", 4)]
    df = spark.createDataFrame(docs, "text string, Text2 long")
    bench = spark.createDataFrame([(1, item.upper())], "item_id long, text string")
    assert sorted(r.Text2 for r in d.clean(df, bench).collect()) == [2, 3, 4]
    kept = {r.Text2: r.text for r in d.clean(df, bench, drop=False).collect()}
    assert kept[1] == "drop " and kept[2] == docs[1][0]
    assert sorted(r.Text2 for r in d.clean(df, bench, longest=20).collect()) == [3, 4]
    assert d.clean(df.limit(0), bench).count() == 0
    assert d.contamination(df.withColumn("doc_id", df.Text2), bench.limit(0)).where("contaminated").count() == 0


def test_shards_of_real_size_are_read_once_for_many_documents(spark, monkeypatch):
    """Three shards of 60,000 words and more; documents quote some of each."""
    rng = random.Random(5)
    items = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(600))) for i in range(400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.prepare(bench)
    assert len(found.shards) == 4 and len(found.grams) == 4
    docs = []
    for i in range(300):
        w = items[i][1].split()
        docs.append(" ".join(["q"] * (i % 40) + w[i : i + 10 + i % 8] + ["z"] * 30))
    reads, plain = [], d._read
    monkeypatch.setattr(d, "_read", lambda uri: reads.append(uri) or plain(uri))
    d._matcher.cache_clear()
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(lo, lo + 50)), "text": docs[lo : lo + 50]}) for lo in range(0, 300, 50)]
    got = [x for _, part in d.judged(iter(batches), 1, found) for x in part]
    assert sum(x.endswith(".shard") for x in reads) == 4  # each once for six batches
    for i, x in enumerate(got):
        n = 10 + i % 8
        assert sum(e - s for s, e in x.spans) == (n if n >= 13 else 0) and x.items == ({str(i)} if n >= 13 else set())


def test_very_long_and_clashing(spark):
    item = " ".join(f"w{i}" for i in range(30))
    long = "filler " * 300_000 + item
    df = spark.createDataFrame([(1, long, 5, 6), (2, item, 7, 8)], "doc_id long, text string, n_words int, Contaminated int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in d.contamination(df, bench).collect()}
    assert got == {1: (300_030, 30, False), 2: (30, 30, True)}
    assert [tuple(r) for r in d.clean(df, bench).collect()] == [(1, long, 5, 6)] and d.clean(df, bench).columns == df.columns
