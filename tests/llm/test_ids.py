"""64-bit ids beside null ids keep all their digits."""

from voltide.llm import chat, decontaminate, html_text, near_dedup, packing, secrets, token_store, warc

BIG = 2**62 + 1


def test_ids_beside_nulls(spark):
    docs = spark.createDataFrame([(BIG, "some words here"), (None, "other words there"), (BIG + 2, "more")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    turns = docs.selectExpr("doc_id AS conv_id", "doc_id AS turn", "'user' AS role", "text")
    want = {BIG, BIG + 2, None}
    ids = lambda df, name="doc_id": {r[name] for r in df.collect()}
    assert ids(token_store.token_output(docs)) == want
    assert ids(packing.pack_examples(docs)) == want
    assert ids(secrets.scan(docs)) == want
    assert ids(decontaminate.contamination(docs, bench)) == want
    assert ids(near_dedup.near_duplicates(docs)) == want
    assert ids(near_dedup.near_duplicates(docs), "component_id") == want
    assert ids(html_text.extract(pages), "page_id") == want
    assert ids(warc.round_trip(pages), "page_id") == want
    assert ids(chat.repair(turns), "conv_id") == want and ids(chat.repair(turns), "turn") == want
