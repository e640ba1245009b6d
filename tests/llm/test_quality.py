import numpy as np
import pyarrow.parquet as pq
import pytest

from voltide.llm import quality

SF = "/root/testdata/sf0.1"


def labelled():
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas().set_index("doc_id")
    rows = pq.read_table(f"{SF}/labels.parquet").to_pandas().drop_duplicates("doc_id").set_index("doc_id")
    return docs.join(rows, how="inner")


def test_held_out_accuracy(spark):
    rows = labelled().sort_index()
    part = rows.index.to_numpy() % 5 == 0
    seen, held = rows[~part], rows[part]
    model = quality.fit(spark.createDataFrame(seen.rename_axis("label_id").reset_index()[["label_id", "text", *quality.TARGETS]]))
    got = np.array([model.scores(t) for t in held["text"]])
    for k, t in enumerate(quality.TARGETS):
        y = held[t].to_numpy()
        hit = (got[:, k] >= 0.5) == (y == 1)
        print(t, len(model.vocab), "features, accuracy", hit.mean(), "on positives", hit[y == 1].mean(), "negatives", hit[y == 0].mean())
        assert hit.mean() > 0.97
        assert hit[y == 1].mean() > 0.9 and hit[y == 0].mean() > 0.9


def test_descent_ends_at_the_least_loss():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 40)) < 0.3).astype(float)
    x[:, 0] = 1
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(size=40))))).astype(float)
    indptr, indices = np.cumsum([0, *x.sum(axis=1).astype(int)]), np.nonzero(x)[1]
    w, b = quality.descend(indptr, indices, y, 40, 400, 0.2)
    err = (1 / (1 + np.exp(-(x @ w + b))) - y) / 300
    assert np.abs(x.T @ err + 0.2 * w / 300).max() < 1e-6 and abs(err.sum()) < 1e-6


def test_telling_parts_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["badword", "badness", "good", "plain", "evening", "even"], 6)) + (" goodly" if i % 3 else " vile") for i in range(200)]
    labels = {"quality": np.array([int("vile" not in t) for t in texts]), "toxic": np.array([int("badness" in t) for t in texts])}
    df = spark.createDataFrame([(i, t, int(labels["quality"][i]), int(labels["toxic"][i])) for i, t in enumerate(texts)], "label_id long, text string, quality int, toxic int")
    got = quality.telling_parts(df, 5, 6.0, 1000)
    rows: dict[int, set[int]] = {}
    for i, t in enumerate(texts):
        for x in t.split():
            for p in quality.parts(x.encode()):
                rows.setdefault(p, set()).add(i)
    off = lambda s, y: abs(sum(y[i] for i in s) - y.mean() * len(s)) / np.sqrt(y.mean() * (1 - y.mean()) * len(s))
    want = {frozenset(s): min(p for p in rows if rows[p] == s) for s in rows.values() if len(s) >= 5 and any(off(s, y) >= 6 for y in labels.values())}
    assert want and got == sorted(want.values())


def test_classify_equals_brute_force(spark):
    """Scores, shrinkage and posterior odds, computed again in NumPy."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["good", "bad", "fair", "odd"], rng.integers(1, 30))), None if i % 17 == 0 else f"h{i % 5 if i % 3 else 0}", None if i % 13 == 0 else f"l{i % 2}", i) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, Kept int")
    labels = spark.createDataFrame([(i, int(t.count("good") > t.count("bad")), int("odd" in t)) for i, t, *_ in rows[:150]], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, z=2.0)
    out = quality.classify(docs, model, keep=("doc_id", "Kept"))
    assert out.columns == ["doc_id", "Kept", "p_quality", "p_toxic", "_kept"]
    got = {r.doc_id: r for r in out.collect()}
    scores = np.array([model.scores(t) for _, t, *_ in rows])
    hosts, paths = np.array([r[2] or "" for r in rows]), np.array([f"{r[2] or ''}|{r[3] or ''}" for r in rows])
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))

    def shrunk(s, groups, prior):
        """Posterior rate of each row's group around its prior."""
        first = {g: i for i, g in reversed(list(enumerate(groups)))}
        names = list(first)
        n = np.array([(groups == g).sum() for g in names], float)
        total, sq = (np.array([x[groups == g].sum() for g in names]) for x in (s, s * s))
        p, r = prior[[first[g] for g in names]], total / n
        noise = np.maximum(1e-9, sq / n - r * r) / n
        k = np.clip((n * p * (1 - p)).sum() / max((n * ((r - p) ** 2 - noise)).sum(), 1e-12 * n.sum()) - 1, 1, 1e9)
        post = dict(zip(names, (k * p + total) / (n + k), strict=True))
        return np.array([post[g] for g in groups])

    want = []
    for k in range(2):
        s = scores[:, k]
        rate = np.full(len(s), s.mean())
        post = shrunk(s, paths, shrunk(s, hosts, rate))
        want.append(1 / (1 + np.exp(-(logit(s) + logit(post) - logit(rate)))))
    for i in range(len(rows)):
        assert got[i].p_quality == pytest.approx(want[0][i], abs=1e-9) and got[i].p_toxic == pytest.approx(want[1][i], abs=1e-9)
        assert got[i]["_kept"] == (want[0][i] >= 0.5 and want[1][i] < 0.5)


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "p", 0.9, 0.1)] * 400 + [("bad", "p", 0.1, 0.1)] * 400 + [("one", "p", 0.0, 0.1)] + [("big", "q", 0.0, 0.1)]
    rows += [(f"h{i}", "p", 0.5 + 0.01 * (i % 7), 0.1) for i in range(60) for _ in range(5)]
    df = spark.createDataFrame(rows, "host string, path string, score_quality double, score_toxic double")
    sites, rate = quality.site_posteriors(df)
    post = {(r.host, r.path): r.post_quality for r in sites.collect()}
    assert post["big", "p"] > 0.85 and post["bad", "p"] < 0.15
    assert 0.1 < post["one", "p"] < rate["quality"]
    assert post["big", "q"] > post["one", "p"]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", None, "en"), (1, "good words here", None, "en"), (2, None, "s", None), (None, "", "s", "de"), (4, "x" * 100_000, "s", "de")], "doc_id long, text string, source string, lang string")
    docs = docs.selectExpr("*", "1 as host", "2 as path", "3 as score_quality", "4 as kept", "5 as P_quality")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 0), (4, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.classify(docs, model).collect()
    assert len(out) == 5 and all(0 < r.p_quality < 1 and 0 < r.p_toxic < 1 for r in out)
    kept = quality.keep_good(docs, model, least_quality=0.0, most_toxic=1.1)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert quality.classify(docs.limit(0), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert quality.classify(docs, none).count() == 5


def test_unlabelled_target_is_its_base_rate(spark):
    model = quality.fit(spark.createDataFrame([(1, "a", 1, 0), (2, "b", 1, 0)], "label_id long, text string, quality int, toxic int"))
    assert model.scores("zzz") == pytest.approx([0.75, 0.25])
