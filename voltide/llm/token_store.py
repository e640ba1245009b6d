"""Token-ID output: a shared zstandard dictionary and one frame per document.

Shard file, all integers little-endian:

    magic "VTOK1\\0\\0\\0", sha256 of the dictionary (32 bytes)
    one zstandard frame per document (its ids as unsigned 16- or 32-bit)
    index: n, then arrays doc_id int64, null uint8, offset int64, size int64, n_tokens int64
    index start (8 bytes), id width (8 bytes), magic

The dictionary lies beside the shards as ``dict-<sha256>.zdict``. A document is
read with two range reads: the index, and its own frame.

Defined results: a null text is empty (only the end id); a null doc_id sorts
first and is kept; repeated doc_ids each keep their own frame, ordered by their
ids; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide.llm import tokens
from voltide.llm.common import c, map_frames
from voltide.session import Scratch, scratch_path, spread

MAGIC = b"VTOK1\0\0\0"
ENCODED = "doc_id long, n_tokens long, frame binary"
MANIFEST = "path string, first_id long, n_docs long, n_tokens long, shard long"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, slot long"


def encode_documents(docs: DataFrame, id_col: str, text_col: str, vocab_path: str, end_id: int, dictionary: bytes, width: int, level: int = 3) -> DataFrame:
    """(doc_id, n_tokens, frame): each whole text's ids and the end id, as one
    zstandard frame of ``width``-byte integers."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, z = tokens.encoder(vocab_path), _compressor(dictionary, level)
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                ids = [x + end for x in enc.encode_all(part["text"].tolist())]
                frames = [z.compress(x if width == 4 else tokens.as_array(x).astype("<u2").tobytes()) for x in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").values, "n_tokens": [len(x) // 4 for x in ids], "frame": frames})

    return map_frames(spread(docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text"))), run, ENCODED)


def sample_dictionary(docs: DataFrame, text_col: str, vocab_path: str, width: int, size: int, documents: int, ids: int) -> bytes:
    """A dictionary fitted on a bounded sample: about ``documents`` documents,
    the first ``ids`` ids of each. It only sets how small the files get."""
    n = docs.count()
    if not n:
        return b""
    texts = docs.select(c(text_col).cast("string").alias("text")).sample(fraction=min(1.0, documents / n), seed=7)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(vocab_path)
        for b in batches:
            yield pd.DataFrame({"ids": [tokens.as_array(x)[:ids].astype("<u2" if width == 2 else "<u4").tobytes() for x in enc.encode_all(b["text"].tolist())]})

    samples = [bytes(r.ids) for r in map_frames(texts, run, "ids binary").limit(2 * documents).toLocalIterator()]
    return train_dictionary([x for x in samples if x], size)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few samples give their own bytes as one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


def pack_shard(rows: Iterator[tuple], out, sha: str, width: int) -> tuple[int, int, int | None]:
    """Write one shard; rows are (doc_id or None, number of ids, frame).
    Returns (documents, ids, first doc_id)."""
    out.write(MAGIC + bytes.fromhex(sha))
    at, index, first = len(MAGIC) + 32, [], None
    for doc_id, n, frame in rows:
        first = doc_id if not index else first
        out.write(frame)
        index.append((doc_id or 0, doc_id is None, at, len(frame), n))
        at += len(frame)
    cols = list(zip(*index, strict=True)) if index else [()] * 5
    out.write(struct.pack("<q", len(index)) + b"".join(np.array(x, k).tobytes() for x, k in zip(cols, ("<i8", "u1", "<i8", "<i8", "<i8"), strict=True)))
    out.write(struct.pack("<qq", at, width) + MAGIC)
    return len(index), int(sum(cols[4])), first


def read_index(f, size: int) -> tuple[dict[str, np.ndarray], int, str]:
    """A shard's index, id width and dictionary hash."""
    f.seek(0)
    head = f.read(len(MAGIC) + 32)
    f.seek(size - 24)
    at, width = struct.unpack("<qq", (tail := f.read(24))[:16])
    if head[: len(MAGIC)] != MAGIC or tail[16:] != MAGIC:
        raise ValueError("not a token shard")
    f.seek(at)
    raw = f.read(size - 24 - at)
    n, at, out = struct.unpack("<q", raw[:8])[0], 8, {}
    for name, kind in (("doc_id", "<i8"), ("null", "u1"), ("offset", "<i8"), ("size", "<i8"), ("n_tokens", "<i8")):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * out[name].itemsize
    return out, width, head[len(MAGIC) :].hex()


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int):
    zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if zdict:
        zdict.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=zdict, write_content_size=True, write_dict_id=False)


@functools.lru_cache(maxsize=4)
def _decompressor(folder: str, sha: str):
    fs, path = _filesystem(f"{folder}/dict-{sha}.zdict")
    with fs.open_input_stream(path) as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != sha:
        raise ValueError(f"dictionary {sha} is damaged")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)


def _ids(frame: bytes, width: int, z) -> bytes:
    raw = z.decompress(frame)
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def read_document(shard: str, doc_id: int) -> np.ndarray:
    """One document's ids by two range reads, without the rest of the shard."""
    fs, path = _filesystem(shard)
    with fs.open_input_file(path) as f:
        index, width, sha = read_index(f, f.size())
        hits = np.flatnonzero((index["doc_id"] == doc_id) & (index["null"] == 0))
        if not len(hits):
            raise KeyError(doc_id)
        f.seek(int(index["offset"][hits[0]]))
        frame = f.read(int(index["size"][hits[0]]))
    return tokens.as_array(_ids(frame, width, _decompressor(shard.rpartition("/")[0], sha)))


def write_tokens(encoded: DataFrame, folder: str, dictionary: bytes, *, width: int, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write ``encode_documents`` rows as shards in ascending doc_id order.

    Returns the manifest, one row per shard. ``encoded`` should be a written
    table: it is read three times.
    """
    spark: SparkSession = encoded.sparkSession
    sha = hashlib.sha256(dictionary).hexdigest()
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dict-{sha}.zdict") as f:
        f.write(dictionary)

    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total * width // shard_bytes), min(spark.sparkContext.defaultParallelism * 4, total // 250_000 + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        fs, at = _filesystem(folder)

        def rows():
            for b in batches:
                for d, n, frame in zip(b["doc_id"], b["n_tokens"], b["frame"], strict=True):
                    yield None if pd.isna(d) else int(d), int(n), bytes(frame)

        # A retried task writes a file of its own; the manifest names the one that counts.
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.vtok"
        with fs.open_output_stream(f"{at}/{name}") as out:
            n, ids, first = pack_shard(rows(), out, sha, width)
        if n:
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "first_id": pd.array([first], "Int64"), "n_docs": [n], "n_tokens": [ids], "shard": [shard]})
        else:
            fs.delete_file(f"{at}/{name}")

    ordered = encoded.repartitionByRange(shards, "doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "frame")
    return map_frames(ordered, run, MANIFEST)


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read shards back: (doc_id, start, n_tokens, ids_crc32, shard, slot) per document.

    The manifest has one row for each tens of MB of ids, so its running total
    is taken on the driver.
    """
    shards, at = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        shards.append((r.path, at, r.shard))
        at += r.n_tokens
    schema = "path string, base long, shard long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, base, shard in zip(b["path"], b["base"], b["shard"], strict=True):
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as f:
                    index, width, sha = read_index(f, f.size())
                    z = _decompressor(path.rpartition("/")[0], sha)
                    starts = int(base) + np.cumsum(index["n_tokens"]) - index["n_tokens"]
                    for lo in range(0, len(starts), 2000):
                        part = {k: v[lo : lo + 2000] for k, v in index.items()}
                        f.seek(int(part["offset"][0]))
                        first = int(part["offset"][0])
                        block = f.read(int(part["offset"][-1] + part["size"][-1]) - first)
                        crc = [zlib.crc32(_ids(block[o - first : o - first + s], width, z)) for o, s in zip(part["offset"].tolist(), part["size"].tolist(), strict=True)]
                        ids = pd.array(part["doc_id"], "Int64")
                        ids[part["null"].astype(bool)] = pd.NA
                        yield pd.DataFrame({"doc_id": ids, "start": starts[lo : lo + 2000], "n_tokens": part["n_tokens"], "ids_crc32": np.array(crc, "i8"), "shard": shard, "slot": np.arange(lo, lo + len(crc))})

    table = spark.createDataFrame(shards, schema)
    if len(shards) > 1:
        table = table.repartition(len(shards))
    return map_frames(table, run, DECODED)


def token_output(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, end_id: int = 1, folder: str | None = None, dictionary_bytes: int = 64 << 10, sample_documents: int = 1000, sample_ids: int = 4096) -> DataFrame:
    """Encode, write and read back; see the module's text for edge cases.

    ``sample_documents`` and ``sample_ids`` bound what the dictionary is fitted
    on; every document is encoded, written and read in full.
    """
    spark = docs.sparkSession
    vocab_path = vocab_path or tokens.default_vocab()
    width = 2 if max(tokens.encoder(vocab_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = sample_dictionary(docs, text_col, vocab_path, width, dictionary_bytes, sample_documents, sample_ids)
    scratch = Scratch(spark)
    encoded = scratch.table(encode_documents(docs, id_col, text_col, vocab_path, end_id, dictionary, width), "encoded")
    manifest = scratch.table(write_tokens(encoded, folder or scratch_path(spark, "shards"), dictionary, width=width), "manifest")
    scratch.free(encoded)
    return read_tokens(spark, manifest)
