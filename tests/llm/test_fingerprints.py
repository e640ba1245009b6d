import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from voltide.llm import fingerprints


def canon(t):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(t).casefold())).strip(" ")


TEXTS = ["Straße", "STRASSE", "é ﬁn", "É FIN", "", None, "a", "a b", " A　 B\n", "\U0001f600x\U0001f600", "Σς", "x" * 90_000, "c d e f", "C  D e f"]


def expected(rows):
    rows = [(d, t or "") for d, t in rows]
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), canon(t), canon(edited), float(canon(t) == canon(edited)), float(canon(t) == canon(after))))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, Digest int").repartition(3)
    got = {r.doc_id: r for r in fingerprints.fingerprints(df, **options).collect()}
    assert len(got) == len(rows)
    by_print, by_text = {}, {}
    for d, n, sha, own, edited, near_edited, near_next in expected(rows):
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near_edited, near_next), d
        for p, t in ((r.fingerprint, own), (r.edited_fingerprint, edited)):
            assert by_print.setdefault(p, t) == t and by_text.setdefault(t, p) == p


def test_fingerprints(spark, monkeypatch):
    rows = [(10 * i, t) for i, t in enumerate(TEXTS * 4)]
    check(spark, rows)
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    check(spark, rows)
    monkeypatch.setattr(fingerprints, "FAN", 3)
    check(spark, [(None, "first"), *rows])
    check(spark, [(5, "Ab")])


def test_equal_buckets_are_compared(spark):
    rows = list(enumerate(TEXTS * 2))
    check(spark, rows, digest=lambda canon: F.substring(fingerprints.wide_digest(canon), 1, 1))


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    out = fingerprints.fingerprints(df).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out}) == 3
    assert fingerprints.fingerprints(df.limit(0)).count() == 0


def successors(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return fingerprints.with_successor(df, "doc_id", "text", fingerprints.wide_digest).select("doc_id", "text", "next_text").collect()


def test_hot_ids_are_split(spark, monkeypatch):
    """One id of many texts, one text of many rows: many ranges, one circle."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    rows = [(i, f"t{i}") for i in range(60)] + [(30, f"many {i}") for i in range(300)] + [(None, "same")] * 200 + [(None, f"n{i}") for i in range(100)]
    slim = spark.createDataFrame(rows, "key long, text string").selectExpr("coalesce(key, -9223372036854775808L) AS key", "xxhash64(text) AS tie")
    placed = fingerprints._ranges(slim)(slim)
    sizes = [r["count"] for r in placed.groupBy("range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 80
    bounds = placed.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("lo"), F.max(F.struct("key", "tie")).alias("hi")).orderBy("range").collect()
    assert all(a.hi <= b.lo for a, b in zip(bounds, bounds[1:], strict=False))
    got = successors(spark, rows)
    order = {t: h for t, h in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").selectExpr("t", "xxhash64(t)").collect()}
    key = lambda r: (r[0] is not None, r[0] or 0, order[r[1]])
    want = sorted(rows, key=key)
    pairs = sorted((r[1], want[(i + 1) % len(want)][1]) for i, r in enumerate(want))
    assert sorted((r.text, r.next_text) for r in got) == pairs


def test_binary_search(spark):
    marks = list(range(0, 1000, 7))
    df = spark.range(-5, 1010).select("id", fingerprints._below(F.array(*map(F.lit, marks)).cast("array<long>"), F.col("id")).alias("n"))
    assert all(r.n == sum(m <= r.id for m in marks) for r in df.collect())


def test_no_python_in_any_plan(spark, monkeypatch):
    """Every plan that is written or returned, for tables with shared digests."""
    plans, plain = [], fingerprints.Scratch.table

    def table(self, df, name):
        plans.append(df._jdf.queryExecution().toString())
        return plain(self, df, name)

    monkeypatch.setattr(fingerprints.Scratch, "table", table)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "A")], "doc_id long, text string")
    out = fingerprints.fingerprints(df, digest=lambda canon: F.substring(fingerprints.wide_digest(canon), 1, 1))
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 5 and not any(re.search("Python|Pandas|Arrow|ScalaUDF", x) for x in plans)
