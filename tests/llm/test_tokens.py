import functools
import random
import zlib

import numpy as np
import pytest

from voltide.llm import packing, token_store, tokens

ODD = ["", None, " ", "\x1c a\x1d", "á ́b É ß İ Σας ΑΣ", "<|endoftext|>x <|startoftext|> y", "don't we'll 12 ½ ٣ 你好 ok", "　a\xa0b\x85c​d", "x" * 5000, "!!'s 'S", " ᠎ z"]


@functools.cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocab())


@functools.cache
def library(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    enc = tokens.WordEncoder(tokens.default_vocab(), max_entries=50)
    rng = random.Random(1)
    chars = "ab \u00c9\u00df\u00e9\u0301'\"!. \t\n \x1c12\u00bd\u0130\u017fSK\u4f60<|endoftext|>\u212a\u212b\u1e9e\xa0\x85\u2003\u0345\u00d7\u00f7\u0149\u013f\u00aa\u00ff\u0178\x00\x7f"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert tokens.as_array(enc.encode(t)).tolist() == library(t), repr(t)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Start string")


def test_store_round_trip(spark, tmp_path):
    df = rows(spark, [*ODD, *ODD]).repartition(3)
    folder = f"file://{tmp_path}/shards"
    out = token_store.token_output(df, folder=folder).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(out, [*ODD, *ODD], strict=True):
        want = np.array([*library(t), 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    shard = next((tmp_path / "shards").glob("*.vtok"))
    with open(shard, "rb") as f:
        index, _, _ = token_store.read_index(f, shard.stat().st_size)
    d = int(index["doc_id"][0])
    assert token_store.read_document(f"{folder}/{shard.name}", d).tolist() == [*library([*ODD, *ODD][d]), 1]
    with pytest.raises(KeyError):
        token_store.read_document(f"{folder}/{shard.name}", 10**9)


def test_store_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "c"), (5, "c"), (5, "a b")], "doc_id long, text string")
    out = token_store.token_output(df).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 5, 5, 5]
    assert [r.start for r in out] == [0, 3, 5, 7]
    assert token_store.token_output(df.limit(0)).count() == 0


def check_pieces(pieces, texts, capacity=2048, max_segments=2048, max_loss=None, losses=None):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for d, t in enumerate(texts):
        ids = np.array([*library(t), 1], "<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            if losses:
                assert p.n_loss == max(0, p.start + p.length - max(p.start, len(ids) - losses[d]))
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity and len(ps) <= max_segments and sum(p.n_loss for p in ps) <= (max_loss or capacity)
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(by_seq)


def test_packing_is_exact_and_tight(spark):
    rng = random.Random(2)
    texts = [*ODD, *(" ".join("word%d" % rng.randrange(99) for _ in range(rng.choice([1, 5, 50, 900, 4000]))) for _ in range(150))]
    pieces = packing.pack_examples(rows(spark, texts).repartition(2), pool=16).collect()
    padding, _ = check_pieces(pieces, texts)
    assert padding == 0


def test_packing_keeps_all_three_limits(spark):
    rng = random.Random(3)
    texts = ["w " * rng.randrange(1, 60) for _ in range(200)]
    losses = [rng.randrange(0, 80) for _ in texts]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(texts, losses, strict=True))], "doc_id long, text string, loss long")
    pieces = packing.pack_examples(df, loss_col="loss", capacity=128, max_segments=4, max_loss=50, pool=16).collect()
    losses = [min(n, len(library(t)) + 1) for n, t in zip(losses, texts, strict=True)]
    check_pieces(pieces, texts, 128, 4, 50, losses)


def test_packing_empty(spark):
    assert packing.pack_examples(rows(spark, ["a"]).limit(0)).count() == 0


def test_pool_holds_remainders_alone():
    """A long text leaves the pool no more than a sequence's ids."""
    packer = packing.Packer(2048, 2048, 2048, 512)
    for i in range(21):
        packer.add(packing.Example(i, bytes(4 * 1_000_003), 1_000_003))
    assert sum(len(e.ids) for e in packer.pool) <= 21 * 4 * 2048
    packer.finish()
    assert sum(x[2] for x in packer.out) == 21 * 1_000_003


def chats(rng, n=400):
    out = []
    for d in range(n):
        parts = []
        for turn in range(rng.randrange(1, 9)):
            parts.append((" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))), turn % 2 == 1))
        out.append((d, parts, d % 3))
    return out


def test_instruction_packing_keeps_segments_loss(spark):
    rng = random.Random(6)
    rows_ = chats(rng, 80) + [(None, [], None), (7, None, 4), (8, [(None, True), ("x", None)], 5)]
    df = spark.createDataFrame(rows_, "conv_id long, segments array<struct<text:string,loss:boolean>>, part long")
    pieces = packing.pack_examples(df, id_col="conv_id", segments_col="segments", part_col="part", capacity=128, max_segments=5, max_loss=40, pool=16).collect()
    want = {}
    for d, parts, part in rows_:
        ids, loss = [], []
        for t, bears in parts or []:
            ids += library(t)
            loss += [bool(bears)] * (len(ids) - len(loss))
        want[d, part] = (np.array([*ids, 1], "<u4"), np.array([*loss, True]))
    at = dict.fromkeys(want, 0)
    for p in sorted(pieces, key=lambda p: p.start):
        ids, loss = want[p.doc_id, p.part]
        assert p.start == at[p.doc_id, p.part] and p.doc_tokens == len(ids)
        at[p.doc_id, p.part] += p.length
        assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.n_loss == loss[p.start : p.start + p.length].sum()
    assert all(at[k] == len(want[k][0]) for k in want)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for ps in by.values():
        assert sum(p.length for p in ps) <= 128 and len(ps) <= 5 and sum(p.n_loss for p in ps) <= 40


def test_vectors_need_no_more_sequences_than_best_fit():
    """Against best fit by tokens alone, under the same three limits."""
    rng = random.Random(7)
    demands = []
    for _ in range(3000):
        n = rng.randrange(5, 400)
        demands.append((n, n if rng.random() < 0.4 else rng.randrange(0, n // 8 + 1)))
    packer = packing.Packer(2048, 24, 700, 512)
    for i, (n, loss) in enumerate(demands):
        packer.add(packing.Example(i, bytes(4 * n), loss))
    packer.finish()
    bins = []
    for n, loss in demands:
        best = min((b for b in bins if b[0] >= n and b[1] >= loss and b[2]), key=lambda b: b[0], default=None)
        if best is None:
            bins.append(best := [2048, 700, 24])
        best[0], best[1], best[2] = best[0] - n, best[1] - loss, best[2] - 1
    assert packer.sequence <= len(bins)
    used = {}
    for p in packer.out:
        used.setdefault(p[5], []).append(p)
    padding = sum((0 if (t := sum(p[2] for p in ps)) & (t - 1) == 0 else 2048 - t) for ps in used.values())
    assert padding <= sum(b[0] for b in bins)


def test_instruction_examples(spark):
    from voltide.llm import chat

    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(200)] + [(2, 0, "user", "q"), (None, 0, None, None)], "conv_id long, turn long, role string, text string")
    fixed = chat.repair(turns)
    got = packing.instruction_examples(fixed, 64).collect()
    assert max(len(r.segments) for r in got) <= 64
    text = "".join(s.text for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.part) for s in r.segments)
    assert text == "".join(r.rendered for r in sorted((r for r in fixed.collect() if r.conv_id == 1), key=lambda r: r.seq))
    assert packing.pack_examples(packing.instruction_examples(fixed.limit(0)), id_col="conv_id", segments_col="segments", part_col="part").count() == 0
