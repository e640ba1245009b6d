"""Benchmark decontamination by a generalised suffix automaton.

Test items are normalised to words and joined into one suffix automaton over
word ids. A document's words stream through it; the state tells how long the
longest match is that ends at each word. Where that reaches a window's length
the last words are an occurrence of a window, and they are hit. An item
shorter than a window is one window by itself.

Before the automaton, short word grams at a fixed stride are looked up in the
grams of all items: any occurrence of a window holds at least one of them whole,
so the parts of a document around no such gram cannot hold a window and are
skipped. That changes no result. A worker keeps 8 bytes per benchmark word for it.

Items are dealt by hash into shards of bounded size. Each shard's automaton is
built once, by one task, and written to the shared folder. Workers gather
documents up to a bound of bytes and then go through the shards, each against
all gathered documents that hold a gram at all; so a shard is read once for
many documents, and few shards are in memory at a time. No item passes the
driver.

Defined results: null and empty texts have no words and are clean; items
without words are ignored; items that share an id count once, and a null id
reads as the empty string; repeated documents are judged alike; of windows that
end at one word each counts; a very long text is read whole; an empty benchmark
hits nothing; an empty table gives no rows; ``clean`` keeps columns of any name.
"""

from __future__ import annotations

import functools
import hashlib
import io
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import c, map_frames, slices, tidy, utf8
from voltide.session import scratch_path, spread

WINDOW = 13
#: Words of test items per shard: a bound on an automaton's memory.
SHARD_WORDS = 60_000
#: Bytes of documents that a worker gathers before it goes through the shards.
GATHER_BYTES = 64 << 20
#: Shards that a worker keeps.
CACHED = 2
_GRAM = 4
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters and all beyond ASCII."""
    return utf8(text).translate(_WORDS).split()


class SuffixAutomaton:
    """Of word-id sequences; ``add`` starts each sequence at the root."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, link: int, out: dict) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, x: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, x: int) -> int:
        q = self.next[last].get(x)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, x)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, x)
        return new

    def add(self, sequence) -> None:
        last = 0
        for x in sequence:
            last = self._extend(last, x)

    def step(self, state: int, length: int, x: int) -> tuple[int, int]:
        """The longest suffix that still matches after one more word."""
        while state > 0 and x not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if x in self.next[state]:
            return self.next[state][x], length + 1
        return 0, 0

    def window(self, state: int, k: int) -> int:
        """The state of the last k words of ``state``'s strings."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state


class _Hashes(dict):
    """64-bit hash of each word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def _hashes() -> _Hashes:
    return _Hashes()


def coded(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes().__getitem__, w), np.uint64, len(w))


def gram_keys(ids: np.ndarray, gram: int, stride: int) -> np.ndarray:
    n = len(ids) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(0, n, stride)
    key = np.zeros(len(at), np.uint64)
    for j in range(gram):
        key = (key ^ ids[at + j]) * _MIX
        key ^= key >> np.uint64(29)
    return key


class Matcher:
    """Finds the windows of a shard's items in documents."""

    def __init__(self, items: list[tuple[str, list[bytes]]], k: int):
        self.k, self.auto = k, SuffixAutomaton()
        items = [(i, coded(w).tolist()) for i, w in items if w]
        for _, w in items:
            self.auto.add(w)
        self.items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for i, w in items:
            state = length = 0
            for at, x in enumerate(w):
                state, length = self.auto.step(state, length, x)
                if at + 1 >= k:
                    self.items.setdefault(self.auto.window(state, k), set()).add(i)
            if len(w) < k:
                short.setdefault(self.auto.window(state, len(w)), []).append((len(w), i))
        self.short = self._inherit(short) if short else {}

    def _inherit(self, short):
        """Short items that end where a state's strings end, links included."""
        out = {0: []}
        for v in sorted(range(1, len(self.auto.length)), key=self.auto.length.__getitem__):
            own = short.get(v, [])
            above = out[self.auto.link[v]]
            out[v] = own + above if own else above
        return {v: x for v, x in out.items() if x}

    def match(self, found: Found) -> None:
        """Add the hit spans, the occurring items and the longest match."""
        k, auto, spans = self.k, self.auto, found.spans
        for lo, part in found.regions:
            state = length = 0
            for i, x in enumerate(part.tolist(), lo):
                state, length = auto.step(state, length, x)
                hit = 0
                if length >= k:
                    hit = k
                    found.longest = max(found.longest, length)
                    found.items |= self.items.get(auto.window(state, k), set())
                for n, item in self.short.get(state, ()):
                    if n <= length:
                        hit, found.longest = max(hit, n), max(found.longest, n)
                        found.items.add(item)
                if hit:
                    if spans and spans[-1][1] >= i + 1 - hit >= spans[-1][0]:
                        spans[-1][1] = max(spans[-1][1], i + 1)
                    else:
                        spans.append([i + 1 - hit, i + 1])


@dataclass
class Found:
    """A document's words in number, its parts around grams, and its hits."""

    n_words: int
    regions: list[tuple[int, np.ndarray]]
    spans: list[list[int]]
    items: set[str]
    longest: int = 0


@dataclass(frozen=True)
class Benchmark:
    """Where the items' grams and the shards' automata are."""

    k: int
    gram: int
    stride: int
    folder: str
    grams: tuple[str, ...]
    shards: tuple[str, ...]

    def look(self, text: str | None) -> Found:
        """The document's parts that may hold a window."""
        w = words(text)
        if not self.grams or not w:
            return Found(len(w), [], [], set())
        ids, grams = coded(w), _grams(self)
        keys = gram_keys(ids, self.gram, self.stride)
        at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        found = np.flatnonzero(grams[at] == keys) * self.stride
        regions: list[list[int]] = []
        for p in found.tolist():
            lo, hi = max(0, p + self.gram - self.k), min(len(w), p + self.k)
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = hi
            else:
                regions.append([lo, hi])
        return Found(len(w), [(lo, ids[lo:hi].copy()) for lo, hi in regions], [], set())

    def judge(self, found: list[Found]) -> None:
        """Go through the shards, each against all documents with such parts."""
        found = [x for x in found if x.regions]
        for shard in self.shards if found else ():
            matcher = _matcher(shard)
            for x in found:
                matcher.match(x)
        for x in found:
            x.spans = merge(x.spans)


def merge(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(map(list, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _read(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def _write(uri: str, data: bytes) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)


@functools.lru_cache(maxsize=CACHED)
def _matcher(shard: str) -> Matcher:
    return pickle.loads(_read(shard))


@functools.lru_cache(maxsize=1)
def _grams(bench: Benchmark) -> np.ndarray:
    return np.unique(np.concatenate([np.load(io.BytesIO(_read(x))) for x in bench.grams]))


def prepare(benchmark: DataFrame, k: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> Benchmark:
    """Deal items into shards and build an automaton of each in a task. Only
    sizes and paths, a few for each shard, reach the driver."""
    # Repeats of an item would all fall into one shard.
    items = benchmark.select(F.coalesce(c(id_col).cast("string"), F.lit("")).alias("item"), c(text_col).cast("string").alias("text")).distinct()

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [len(words(t)) for t in b["text"]]})

    r = map_frames(items, sizes, "n long").where("n > 0").agg(F.sum("n").alias("n"), F.min("n").alias("least")).first()
    folder = scratch_path(benchmark.sparkSession, "items")
    if not r.n:
        return Benchmark(k, 1, 1, folder, (), ())
    least = min(k, r.least)
    gram, stride = min(_GRAM, least), least - min(_GRAM, least) + 1
    shards = -(-r.n // SHARD_WORDS)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        held = [(i, w) for i, t in zip(part["item"], part["text"], strict=True) if (w := words(t))]
        base = f"{folder}/{uuid.uuid4().hex}"  # a retried task writes files of its own
        out = io.BytesIO()
        np.save(out, np.unique(np.concatenate([np.zeros(0, np.uint64), *(gram_keys(coded(w), gram, 1) for _, w in held)])))
        _write(f"{base}.grams", out.getvalue())
        _write(f"{base}.shard", pickle.dumps(Matcher(held, k)))
        return pd.DataFrame({"grams": [f"{base}.grams"], "shard": [f"{base}.shard"]})

    dealt = items.withColumn("at", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    rows = dealt.groupBy("at").applyInPandas(build, "grams string, shard string").collect()
    return Benchmark(k, gram, stride, folder, tuple(x.grams for x in rows), tuple(x.shard for x in rows))


def judged(batches: Iterator[pa.RecordBatch], at: int, bench: Benchmark) -> Iterator[tuple[pa.RecordBatch, list[Found]]]:
    """Each batch with what was found in its texts (column ``at``)."""
    held: list[tuple[pa.RecordBatch, list[Found]]] = []
    size = 0

    def done() -> list[tuple[pa.RecordBatch, list[Found]]]:
        nonlocal held, size
        bench.judge([x for _, found in held for x in found])
        out, held, size = held, [], 0
        return out

    most = GATHER_BYTES if len(bench.shards) > CACHED else 0  # shards that stay in memory need no gathering
    for batch in batches:
        for b in slices(batch):
            held.append((b, [bench.look(t.as_py()) for t in b.column(at)]))
            size += b.nbytes
            if size > most:
                yield from done()
    yield from done()
    _hashes().clear()  # other stages share this worker's memory
    tidy()


def is_contaminated(n_hit: int, n_words: int, share: int = 20) -> bool:
    """Hit at all, and one word in ``share`` or more."""
    return n_hit > 0 and share * n_hit >= n_words


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document; see the module's text."""
    bench = prepare(benchmark, window)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in judged(batches, 1, bench):
            hits = [sum(e - s for s, e in x.spans) for x in found]
            items = [hashlib.sha256(",".join(sorted(x.items)).encode("utf-8", "surrogatepass")).hexdigest() for x in found]
            over = [is_contaminated(n, x.n_words) for n, x in zip(hits, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, f.type) for x, f in zip(([x.n_words for x in found], hits, [len(x.items) for x in found], items, over, [x.longest for x in found]), list(schema)[1:], strict=True))], schema=schema)

    return spread(docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text"))).mapInArrow(run, HITS)


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Byte range in UTF-8 of each word."""
    raw = utf8(text).translate(_WORDS)
    out, at = [], 0
    for w in raw.split():
        at = raw.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def excise(text: str, spans) -> str:
    """The text without the words of the spans, ends included."""
    raw, where, out, at = utf8(text), word_offsets(text), [], 0
    for s, e in spans:
        out.append(raw[at : where[s][0]])
        at = where[e - 1][1]
    return (b"".join(out) + raw[at:]).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, share: int = 20, longest: int | None = None, drop: bool = True) -> DataFrame:
    """Documents without benchmark passages; all columns kept.

    A document is over the limits if it is contaminated (coverage) or, where
    ``longest`` is set, holds a match of that many words or more. Those go; with
    ``drop=False`` they stay and lose the matching spans. All others stay as
    they are.
    """
    bench, schema, at = prepare(benchmark, window), docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in judged(batches, at, bench):
            over = [is_contaminated(sum(e - s for s, e in x.spans), x.n_words, share) or (longest is not None and x.longest >= longest) for x in found]
            if drop:
                yield b.filter(pa.array([not x for x in over], pa.bool_()))
            elif any(over):
                cols = list(b.columns)
                cols[at] = pa.array([excise(t.as_py(), x.spans) if o else t.as_py() for t, x, o in zip(b.column(at), found, over, strict=True)], b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
            else:
                yield b

    return spread(docs).mapInArrow(run, schema)
