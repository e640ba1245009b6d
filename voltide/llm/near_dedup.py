"""MinHash near-duplicate detection by a chosen-path set similarity join.

A document's set is its distinct word shingles; equal sets are one vertex. A
forest of independent trees then branches the vertices: at each node a hash
function that belongs to the node selects every member's minwise token, and the
members go to the child of that token. Most nodes, picked by their key, branch
by a second token too, so that a pair at the threshold keeps sharing children.
A large node is parted several levels at once, each of which branches as if it
were made alone; no path is longer than DEPTH levels in all. A node is done
when it is small; its members are then compared exhaustively, first by sketch,
then on full sets, and the links that hold up are emitted as a forest of the
node, which joins the same documents as all its links would. Components of
these forests over all trees are the classes. Trees are repeated to the target
recall at the last level; see ``trees_for``.

Groups of near copies, or texts around one long passage, may be too alike for
any depth to part them. A node that is still large at the last level is dealt
into blocks of bounded size by hash; every block also gets the node's hubs, its
members of smallest hash. That joins what is close, and no more. The members of
all such nodes, which are few, then go through an exact completion: shingles
are ordered from rare to frequent, two linked sets must share one among the
first of each (``100 * shared >= percent * union`` leaves so few for the rest),
and only members that share one and differ in class so far are compared. What
the members have in common is frequent, comes last and is not looked at, so
members that are alike but not linked make few comparisons. No link inside such
a node is lost, no stage makes all pairs of a group, no node is gathered in one
task, and lists of members are cut by count and by bytes.

Sketches only rule out pairs whose estimate is over four standard errors below
the threshold.

Defined results: texts without words, empty or null have an empty set, link
with nothing and are kept; rows that share a doc_id are told apart by their
text in ``deduplicate`` and share a row each in ``near_duplicates``; a null
doc_id never names a class that has another id, and a class of null ids alone
has a null component_id and is kept; equal texts link whatever their case and
spacing; ties are broken by the smallest id, then the smallest text hash; a very
long text is one set, compared in lists cut by bytes; an empty table gives no
rows; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.common import broadcast_if_small, c, fresh, join_hot, map_frames, utf8
from voltide.llm.components import connected_components
from voltide.session import Scratch, spread

SHINGLE = 5
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Slots of a sketch, and how many of its hash functions nodes choose from.
SKETCH, BANK = 128, 64
#: Members of a node that are compared exhaustively, and of a block.
LEAF = 256
#: Levels below a tree's first node.
DEPTH = 3
HUBS = 4
#: Of 1000 nodes, how many branch by two tokens.
TWIN = 700
#: Bytes of full sets in one list of members.
LIST_BYTES = 32 << 20
#: Counters for the frequency of shingles; they only order them.
SLOTS = 1 << 18
VERTEX = "doc_id long, text_hash long, n long, v binary, sketch binary"


def meeting(similarity: float, levels: int) -> float:
    """Probability that a pair shares a node ``levels`` below the first one of a
    tree: a branching process, whose functions are taken as independent."""
    share = 1.0
    for _ in range(levels):
        apart = 1 - similarity * share
        share = 1 - apart * (1 - TWIN / 1000 * (1 - apart))
    return similarity * share


def trees_for(threshold: float, recall: float) -> int:
    """Trees after which a pair at the threshold has met with ``recall`` in a
    node of the last level, so in a group of any size: what is still large
    there loses no link. The functions a pair agrees on are of one small bank,
    so their number is drawn once for all trees."""
    luck = [(math.comb(BANK, k) * threshold**k * (1 - threshold) ** (BANK - k), 1 - meeting(k / BANK, DEPTH)) for k in range(BANK + 1)]
    return next(n for n in itertools.count(1) if sum(p * apart**n for p, apart in luck) <= 1 - recall)


class _WordHash(dict):
    """64-bit hash of each word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def _word_hash() -> _WordHash:
    return _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = utf8(text).lower().split()  # bytes: A-Z alone change case; \x20 and \x09-\x0D alone part words
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash().__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
        for j in range(n):
            out = out * _A + h[j : len(h) - n + 1 + j]
        return np.unique(_mix(out))


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 32, SKETCH, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SKETCH, np.uint32)


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set, as uint32."""
    a, b = _functions()
    x = (s >> np.uint64(32)).astype(np.uint32)
    y = s.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        z = x[lo : lo + 2048, None] * a
        z ^= z >> np.uint32(15)
        z += y[lo : lo + 2048, None] * b
        z *= np.uint32(0x85EBCA6B)
        z ^= z >> np.uint32(13)
        np.minimum(out, z.min(axis=0), out=out)
    return out


def pack_sketch(m: np.ndarray) -> bytes:
    """The low halves of all minima and the high halves of the bank's."""
    return np.concatenate([m.astype("<u2"), (m[:BANK] >> np.uint32(16)).astype("<u2")]).tobytes()


def _halves(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, sketches)), "<u2").reshape(-1, SKETCH + BANK)


def banks(sketches) -> np.ndarray:
    """The bank's minima of each packed sketch."""
    h = _halves(sketches)
    return h[:, :BANK].astype(np.uint32) | h[:, SKETCH:].astype(np.uint32) << np.uint32(16)


def _fold(keys: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Children's keys from their parents' and the chosen tokens."""
    with np.errstate(over="ignore"):
        return _mix(keys * _A + _mix(tokens.astype(np.uint64) + _C))


def roots(bank: np.ndarray, trees: int) -> np.ndarray:
    """First nodes of each member, a row each: tree t branches by its own function."""
    t = np.arange(trees, dtype=np.uint64)
    return _fold(np.broadcast_to(_mix(t + _B), (len(bank), trees)), bank[:, np.arange(trees) % BANK])


def children(keys: np.ndarray, bank: np.ndarray, steps: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Nodes ``steps`` levels below each member's node: (member's row, key).
    The nodes of each level may branch twice."""
    rows = np.arange(len(keys))
    for _ in range(steps):
        pick = _mix(keys ^ _C)
        first = (pick % np.uint64(BANK)).astype(np.int64)
        second = (first + 1 + (pick >> np.uint64(40)).astype(np.int64) % (BANK - 1)) % BANK
        twin = (pick >> np.uint64(8)) % np.uint64(1000) < TWIN
        one = _fold(keys, bank[rows, first])
        two = _fold(keys[twin], bank[rows[twin], second[twin]].astype(np.uint64) | np.uint64(1 << 40))
        rows, keys = np.concatenate([rows, rows[twin]]), np.concatenate([one, two])
    return rows, keys


def vertices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each document's set size, vertex and packed sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                part, rows = b.iloc[lo : lo + 1000], []
                for t in part["text"]:
                    s = shingle_set(t)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), pack_sketch(minima(s))) if len(s) else (0, None, None))
                out = pd.DataFrame(rows, columns=["n", "v", "sketch"])
                out.insert(0, "text_hash", part["text_hash"].values)
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").values)
                yield out
        _word_hash().clear()  # other stages share this worker's memory

    text = c(text_col).cast("string")
    return map_frames(spread(docs.select(c(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))), run, VERTEX)


def _first_nodes(uniq: DataFrame, trees: int) -> DataFrame:
    """(key, v, depth): each vertex in the first node of each tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = roots(banks(b["sketch"]), trees) if len(b) else np.zeros((0, trees), np.uint64)
            yield pd.DataFrame({"key": keys.ravel().view(np.int64), "v": np.repeat(b["v"].to_numpy(), trees), "depth": 0})

    return map_frames(uniq.select("v", "sketch"), run, "key long, v binary, depth int")


def _descend(large: DataFrame, uniq: DataFrame) -> DataFrame:
    """Members (key, v, depth) of large nodes (key, v, m, depth), some levels
    down, none below the last."""
    some = Scratch(uniq.sparkSession).table(large.select("v").distinct(), "in_large")
    sketches = uniq.select("v", "sketch").join(broadcast_if_small(some), "v", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for steps, part in b.groupby(b["steps"].astype(int)):
                rows, keys = children(part["key"].to_numpy(np.int64).view(np.uint64), banks(part["sketch"]), steps)
                yield pd.DataFrame({"key": keys.view(np.int64), "v": part["v"].to_numpy()[rows], "depth": part["depth"].to_numpy(np.int32)[rows] + steps})

    steps = F.greatest(F.lit(1), F.floor(F.log2((F.col("m") / LEAF).cast("int").cast("double")))).cast("int")
    steps = F.least(steps, F.lit(DEPTH) - F.col("depth"))
    return map_frames(large.withColumn("steps", steps).join(sketches, "v").select("v", "key", "steps", "depth", "sketch"), run, "key long, v binary, depth int")


def spanning(near: np.ndarray) -> list[list[tuple[int, int]]]:
    """Edges of a spanning tree of each component of a boolean matrix that has
    two members or more."""
    left, out = np.ones(len(near), bool), []
    for start in range(len(near)):
        if left[start]:
            left[start], todo, tree = False, [start], []
            while todo:
                i = todo.pop()
                new = np.flatnonzero(near[i] & left)
                left[new] = False
                tree += [(i, j) for j in new.tolist()]
                todo += new.tolist()
            if tree:
                out.append(tree)
    return out


def plausible_groups(vs: list[bytes], sizes: np.ndarray, sketches: np.ndarray, threshold: float) -> list[list[bytes]]:
    """Groups of a node's members that sketches can't tell apart."""
    floor = threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)
    near = np.zeros((len(vs), len(vs)), bool)
    for i in range(len(vs)):
        near[i] = (sketches == sketches[i]).sum(axis=1) >= floor * SKETCH
    near &= np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes)
    return [sorted({vs[i] for edge in tree for i in edge}) for tree in spanning(near)]


def shared_counts(sets: list[np.ndarray], most: int = 1 << 23) -> np.ndarray:
    """Sizes of all intersections of a bounded group: by one product of
    incidence matrices, in slices of the universe that hold ``most`` cells."""
    universe, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out, width = np.zeros((len(sets), len(sets))), max(1, most // len(sets))
    for lo in range(0, len(universe), width):
        now = (where >= lo) & (where < lo + width)
        m = np.zeros((len(sets), min(width, len(universe) - lo)), np.float32)
        m[rows[now], where[now] - lo] = 1
        out += m @ m.T
    return out


def linked_forest(vs: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links on full sets that connect what all links of the group connect."""
    if len(vs) < 2:
        return []
    order = sorted(range(len(vs)), key=vs.__getitem__)  # trees then hang from a component's smallest vertex
    vs, sets = [vs[i] for i in order], [sets[i] for i in order]
    sizes, both = np.array([len(s) for s in sets]), shared_counts(sets)
    near = 100 * both >= percent * (sizes[:, None] + sizes - both)
    return [(vs[i], vs[j]) for tree in spanning(near) for i, j in tree]


def _members(lists: DataFrame, lookup: DataFrame, cols: list[str]) -> DataFrame:
    """Lists of vertices with a column struct for each member."""
    flat = lists.select(F.xxhash64("list").alias("lid"), F.explode("list").alias("v"))
    return flat.join(lookup.select("v", *cols), "v").groupBy("lid").agg(F.collect_list(F.struct("v", *cols)).alias("members"))


def within_bytes(vs: list[bytes], sizes: list[int], most: int) -> list[list[bytes]]:
    """Lists that hold every pair of ``vs`` and full sets of about ``most``
    bytes each: parts of half that, two by two."""
    parts, now, held = [], [], 0
    for v, n in zip(vs, sizes, strict=True):
        if now and held + 8 * n > most // 2:
            parts.append(now)
            now, held = [], 0
        now.append(v)
        held += 8 * n
    parts.append(now)
    return [a + b for a, b in itertools.combinations(parts, 2)] if len(parts) > 1 else parts


def _refine(lists: DataFrame, uniq: DataFrame, threshold: float) -> DataFrame:
    """Lists cut into groups that sketches can't tell apart, and by bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for members in b["members"]:
                vs, ns = [bytes(m["v"]) for m in members], np.array([m["n"] for m in members])
                size = dict(zip(vs, ns.tolist(), strict=True))
                for group in plausible_groups(vs, ns, _halves(m["sketch"] for m in members)[:, :SKETCH], threshold):
                    out += within_bytes(group, [size[v] for v in group], LIST_BYTES)
            yield pd.DataFrame({"list": out})

    scratch = Scratch(uniq.sparkSession)
    lists = scratch.table(lists, "lists")
    some = scratch.table(lists.select(F.explode("list").alias("v")).distinct(), "in_lists")
    uniq = uniq.join(broadcast_if_small(some), "v", "left_semi")
    return map_frames(_members(lists, uniq, ["n", "sketch"]).select("members"), run, "list array<binary>").distinct()


def _confirm(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Forest edges of each list, on full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us, vs = [], []
            for members in b["members"]:
                found = {bytes(m["v"]): np.frombuffer(bytes(m["shingles"]), np.uint64) for m in members}
                for x, y in linked_forest(list(found), list(found.values()), percent):
                    us.append(x)
                    vs.append(y)
            yield pd.DataFrame({"u": us, "v": vs})

    return map_frames(_members(lists, sets, ["shingles"]).select("members"), run, "u binary, v binary").distinct()


def _shingles(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(v, shingles, stuck): full sets of the wanted vertices (v, doc_id,
    stuck), from one document each."""
    ids = broadcast_if_small(wanted.select(F.col("doc_id").alias("wanted_id")))
    base = docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text"))
    rows = base.join(ids, base["doc_id"].eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                sets = [shingle_set(t).tobytes() for t in b["text"].iloc[lo : lo + 1000]]
                yield pd.DataFrame({"v": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "shingles": sets})

    found = map_frames(rows.select("text"), run, "v binary, shingles binary")
    return found.join(broadcast_if_small(wanted.select("v", "stuck")), "v").groupBy("v").agg(F.first("shingles").alias("shingles"), F.first("stuck").alias("stuck"))


def _blocks(stuck: DataFrame) -> DataFrame:
    """Lists of the members (key, v) of nodes that no depth parts: blocks of
    bounded size, each with the node's hubs."""
    scratch = Scratch(stuck.sparkSession)
    hubs = (F.min(F.struct(F.xxhash64("v", F.lit(j)).alias("h"), "v")).alias(f"hub{j}") for j in range(HUBS))
    sized = scratch.table(stuck.groupBy("key").agg(F.count("*").alias("m"), *hubs).withColumn("blocks", F.ceil(F.col("m") / (LEAF - HUBS)).cast("int")), "sized")
    own = join_hot(stuck, sized.select("key", "m", "blocks"), "key", "m").select("key", F.pmod(F.xxhash64("v", F.lit(99)), F.col("blocks")).cast("int").alias("block"), "v")
    every = sized.select("key", F.explode(F.array_distinct(F.array(*(F.col(f"hub{j}.v") for j in range(HUBS))))).alias("v"), "blocks")
    every = every.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "v")
    lists = own.unionByName(every).groupBy("key", "block").agg(F.sort_array(F.collect_set("v")).alias("list"))
    return lists.where(F.size("list") > 1).select("list")


def similarity_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, class), one row per document;
    ``class`` is the class's root vertex, null for texts without words.

    Two documents link if 100 * intersection >= ``percent`` * union of their
    sets; a class is a connected component, named by its smallest doc_id.
    """
    spark, threshold = docs.sparkSession, percent / 100
    scratch, trees = Scratch(spark), trees_for(threshold, recall)
    wide = scratch.table(vertices(docs, id_col, text_col), "vertices")
    firsts = (F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    uniq = scratch.table(wide.where("n > 0").groupBy("v").agg(*firsts), "unique")
    each = scratch.table(wide.drop("sketch"), "each")
    scratch.free(wide)

    lists, stuck = [], []  # large nodes of the last level are stuck
    level = scratch.table(_first_nodes(uniq, trees), "level")
    while True:
        counts = scratch.table(level.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "counts")
        rows = scratch.table(join_hot(level, counts, "key", "m"), "nodes")
        scratch.free(level, counts)
        lists.append(rows.where(F.col("m") <= LEAF).groupBy("key").agg(F.sort_array(F.collect_list("v")).alias("list")).select("list"))
        large = rows.where(F.col("m") > LEAF)
        last, above = large.where(F.col("depth") == DEPTH), large.where(F.col("depth") < DEPTH)
        if last.limit(1).count():
            stuck.append(last.select("key", "v"))
        if not above.limit(1).count():
            break
        level = scratch.table(_descend(above, uniq), "level")
    dense = None
    if stuck:
        held = scratch.table(functools.reduce(DataFrame.unionByName, stuck), "stuck")
        lists.append(_blocks(held))
        dense = held.select("v").distinct()

    every = functools.reduce(DataFrame.unionByName, lists).distinct()
    refined = scratch.table(_refine(every, uniq, threshold), "refined")
    involved = refined.select(F.explode("list").alias("v"), F.lit(False).alias("stuck"))
    if dense is not None:
        involved = involved.unionByName(dense.select("v", F.lit(True).alias("stuck")))
    involved = involved.groupBy("v").agg(F.max("stuck").alias("stuck"))
    wanted = scratch.table(involved.join(uniq.select("v", F.col("first_id").alias("doc_id")), "v"), "wanted")
    sets = scratch.table(_shingles(docs, id_col, text_col, wanted), "sets")
    edges = scratch.table(_confirm(refined, sets, percent), "confirmed")
    labels = scratch.table(connected_components(edges), "labels")
    if dense is not None:
        more = _complete(scratch, sets, labels, uniq, percent)
        labels = scratch.table(connected_components(edges.unionByName(more)), "labels")
    scratch.free(sets, refined, wanted)

    named = scratch.table(uniq.select("v", "first_id", "copies").join(labels.withColumnRenamed("node", "v"), "v", "left").withColumn("class", F.coalesce("root", "v")), "named")
    classes = scratch.table(named.groupBy("class").agg(F.min("first_id").alias("class_id"), F.count("*").alias("vertices")), "class_ids")
    own = scratch.table(join_hot(named, classes, "class", "vertices").select("v", "copies", "class", "class_id"), "own")
    with_words = join_hot(each.where("n > 0"), own, "v", "copies")
    without = each.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("binary").alias("class"), F.col("doc_id").alias("class_id"))
    out = with_words.select("doc_id", "text_hash", "n", "class", "class_id").unionByName(without)
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("class_id").alias("component_id"), "class")


def slot_ranks(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of each slot are, on a scale of logarithms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            for s in b["shingles"]:
                np.add.at(counts, (np.frombuffer(s, np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": at, "n": counts[at]})

    found = map_frames(sets.select("shingles"), run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    ranks = np.zeros(SLOTS, np.uint8)
    ranks[found["slot"].to_numpy(np.int64)] = 1 + np.floor(4 * np.log2(found["n"].to_numpy(np.float64)))
    return ranks


def prefix(s: np.ndarray, ranks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The set's rarest shingles, of which a linked set holds one, and for each
    the largest size of a set that may link and has it as the first one shared.

    A set of n that shares its shingles from position p on, so n - p at most,
    with one of m: 100 (n - p) >= percent (n + m - (n - p))."""
    n = len(s)
    least = -(-percent * n // 100)  # shared with any linked set
    rank = ranks[(s % np.uint64(SLOTS)).astype(np.int64)]
    order = np.lexsort((s, rank))[: n - least + 1]
    left = n - np.arange(len(order))
    return s[order].view(np.int64), (100 * left - percent * (n - left)) // percent


def _complete(scratch: Scratch, sets: DataFrame, labels: DataFrame, uniq: DataFrame, percent: int) -> DataFrame:
    """Forest edges between members of stuck nodes that differ in class."""
    held = sets.where("stuck").select("v", "shingles")
    shipped = held.sparkSession.sparkContext.broadcast(slot_ranks(held))
    known = held.join(labels.select(F.col("node").alias("v"), "root"), "v", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, parts, held = shipped.value, [], 0

        def ready() -> pd.DataFrame:
            tokens, mosts, rows = (np.concatenate(x) for x in zip(*((t, m, np.full(len(t), i)) for i, (t, m, *_) in enumerate(parts)), strict=True))
            vs, ns, labels = (np.array(x, object)[rows] for x in zip(*(x[2:] for x in parts), strict=True))
            parts.clear()
            return pd.DataFrame({"token": tokens, "v": vs, "n": ns, "most": mosts, "label": labels})

        for b in batches:
            for v, raw, label in zip(b["v"], b["shingles"], b["label"], strict=True):
                s = np.frombuffer(raw, np.uint64)
                tokens, most = prefix(s, ranks, percent)
                parts.append((tokens, most, v, len(s), label))
                held += len(tokens)
                if held > 50_000:
                    yield ready()
                    held = 0
        if parts:
            yield ready()

    firsts = map_frames(known.select("v", "shingles", F.xxhash64(F.coalesce("root", "v")).alias("label")), run, "token long, v binary, n long, most long, label long")
    firsts = scratch.table(firsts, "firsts")
    mixed = firsts.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"))
    mixed = scratch.table(mixed.where("low != high").select("token", "m", "least"), "mixed")
    met = scratch.table(join_hot(firsts, mixed, "token", "m").where("most >= least").select("token", "v", "label"), "met")
    scratch.free(firsts)
    # A token's members outside its largest class are cut into slices, which meet all of its members.
    sizes = met.groupBy("token", "label").agg(F.count("*").alias("k"))
    heads = sizes.groupBy("token").agg(F.sum("k").alias("m"), F.max(F.struct("k", "label")).alias("top")).withColumn("others", F.col("m") - F.col("top.k")).where("others > 0")
    heads = scratch.table(heads.select("token", "m", "others", F.col("top.label").alias("main")), "heads")
    placed = scratch.table(join_hot(met, heads, "token", "m"), "placed")
    few = placed.where(F.col("m") <= LEAF).groupBy("token").agg(F.sort_array(F.collect_list("v")).alias("list")).select("list").distinct()
    many = placed.where(F.col("m") > LEAF)
    deal = lambda seed, rows: F.pmod(F.xxhash64("v", F.lit(seed)), F.ceil(F.col(rows) / LEAF))
    slices = many.where("label != main").groupBy("token", deal(7, "others").alias("slice")).agg(F.collect_list("v").alias("some"))
    blocks = many.groupBy("token", deal(99, "m").alias("block")).agg(F.collect_list("v").alias("own"))
    met_lists = blocks.join(slices, "token").select(F.sort_array(F.array_union("own", "some")).alias("list"))
    refined = scratch.table(_refine(few.unionByName(met_lists).distinct(), uniq, percent / 100), "refined")
    return scratch.table(_confirm(refined, sets, percent), "completed")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document."""
    classes = similarity_classes(docs, id_col=id_col, text_col=text_col, percent=percent, recall=recall)
    return classes.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """One document of each class, with all its columns: that with the smallest
    doc_id, of rows that share it the one of smallest text hash. Exact repeats
    of the kept row go too."""
    scratch = Scratch(docs.sparkSession)
    classes = scratch.table(similarity_classes(docs, id_col=id_col, text_col=text_col, percent=percent, recall=recall), "classes")
    words = classes.where("n_shingles > 0")
    # Null ids come last: they are kept only where a class has no other.
    best = words.groupBy("class").agg(F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"), F.count("*").alias("rows"))
    best = scratch.table(best.select("class", "rows", F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash")), "best")
    judged = join_hot(words, best, "class", "rows").select("doc_id", "text_hash", (F.col("best_id").eqNullSafe(F.col("doc_id")) & (F.col("best_hash") == F.col("text_hash"))).alias("is_best"))
    tally = scratch.table(judged.groupBy("doc_id", "text_hash", "is_best").agg(F.count("*").alias("copies")), "tally")
    gone_id, gone_text = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    named = lambda rows: rows.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_text))
    gone = scratch.table(named(tally.where("not is_best")), "gone")
    twice = scratch.table(named(tally.where("is_best and copies > 1")), "twice")
    match = c(id_col).cast("long").eqNullSafe(c(gone_id)) & (F.xxhash64(c(text_col).cast("string")) == c(gone_text))
    out = docs.join(broadcast_if_small(gone), match, "left_anti")
    if twice.limit(1).count():
        single = out.join(broadcast_if_small(twice), match, "left_semi").dropDuplicates([id_col, text_col])
        out = out.join(broadcast_if_small(twice), match, "left_anti").unionByName(single)
    return out
