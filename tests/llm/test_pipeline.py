import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_decontaminate import brute as contaminated  # noqa: E402
from test_near_dedup import brute as components  # noqa: E402
from test_secrets import plain  # noqa: E402
from test_tokens import check_pieces  # noqa: E402

import corpus_pipeline  # noqa: E402
from voltide.llm import quality, secrets  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Each stage's input and output rows, written and read as the driver does."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf)
        rows = after.collect()
        out.append((docs.collect(), rows, docs.columns, after.columns))
        docs = spark.createDataFrame(rows, after.schema)
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_all_but_the_last_keep_the_columns(stages):
    for before, after, had, has in stages[:-1]:
        assert had == has and len(before) >= len(after) > 0


def test_quality_keeps_clean_documents(spark, sf, stages):
    before, after, *_ = stages[0]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = by_id(after)
    good = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    bad = [d for d, r in labels.items() if r.quality == 0 or r.toxic == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d in kept for d in bad) <= 0.2 * len(bad)
    assert all(kept[d] == r for d, r in by_id(before).items() if d in kept)
    assert set(quality.TARGETS) == {"quality", "toxic"}


def test_dedup_equals_brute_force(stages):
    before, after, *_ = stages[1]
    want = {d for d, _, c in components([(r.doc_id, r.text) for r in before], 80) if d == c}
    assert set(by_id(after)) == want


def test_decontamination_equals_brute_force(spark, sf, stages):
    before, after, *_ = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 13]) for _, t in items for w in [re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())] for i in range(len(w) - 12)}
    assert grams
    want = {r.doc_id for r in before if not contaminated(r.text, items)[4]}
    assert set(by_id(after)) == want


def test_secrets_are_masked(stages):
    before, after, *_ = stages[3]
    assert len(before) == len(after)
    for d, r in by_id(after).items():
        old = by_id(before)[d].text
        assert not plain(r.text)
        assert r.text == old if not secrets.find_spans(old) else r.text != old


def test_packing_is_exact(stages):
    before, after, *_ = stages[4]
    ids = sorted(by_id(before))
    texts = [by_id(before)[d].text for d in ids]
    place = {d: i for i, d in enumerate(ids)}
    renamed = [type("P", (), {**p.asDict(), "doc_id": place[p.doc_id]}) for p in after]
    check_pieces(renamed, texts)


def test_nulls_repeats_empty_and_clashing_columns(spark, sf, tmp_path):
    """The whole pipeline over odd rows, and over none."""
    import shutil

    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    good = next(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").collect() if len(r.text) > 500)
    rows = [(1, good, "en", "s"), (1, good, "en", "s"), (2, good.upper(), None, None), (None, good + " more", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, passage, "en", "s"), (6, "w " * 50_000, "en", "s")]
    names = "doc_id long, text string, lang string, source string, kept int, score_quality string, gone_id int, n_words int"
    for name, some in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        folder.mkdir()
        for table in ("labels", "benchmark"):
            shutil.copy(f"{sf}/{table}.parquet", folder)
        spark.createDataFrame([(*r, 1, "x", 2, 3) for r in some], names).write.parquet(f"file://{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, f"file://{folder}").collect()
        ids = {r.doc_id for r in out}
        assert ids <= {1, None, 2, 3, 4, 6} and (1 in ids) == bool(some)  # 5 is a benchmark passage
        assert 2 not in ids  # a copy of 1
        assert sum(r.length for r in out if r.doc_id == 1) == next((r.doc_tokens for r in out if r.doc_id == 1), 0)  # its repeat went
