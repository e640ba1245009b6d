"""Quality and toxicity by hierarchical empirical Bayes.

Evidence comes from two sides. A logistic classifier per target reads the
document: words that are frequent enough in its training rows, and binned
measures of form. Grouped aggregation over all documents then gives each host
and each path below it a posterior rate, shrunk towards the host's, and the
host's towards the global rate; how strongly is set by the spread between
hosts and between paths (method of moments). A document's posterior odds are
its classifier odds times the odds of its path over the global odds, so that a
sparse site says nothing and a large one speaks for its own documents.

The classifier is fitted on a bounded sample: the ``train_rows`` labelled
documents of smallest id hash. Executors read it: they count in how many rows of
each value every word stands, and turn the rows into sparse features; counts of
the words that tell, measures of form and sparse rows come back, no text does.
Words that stand in the same rows make one feature, and each target chooses its
own share of them. Rates cover all documents. Each document is scored once; the
scored rows, with the columns that are kept, are written to the shared folder
and read for the rates and for the result. Only sums per path move.

Defined results: a null or empty text is scored by its form alone; a null host
or path part is a site named by the empty string; rows are scored one by one,
so repeated rows agree and null ids are kept; a very long text is read whole, in
the task that holds it; labels with a null id or null targets are not trained
on, repeated labels for an id count as one (the largest); of features that tell
as much, the one of smallest hash is taken; without labels of both values a
target's score is its smoothed base rate; an empty table gives no rows; columns
of any name are kept, and what is added takes another name where one is taken.
"""

from __future__ import annotations

import functools
import itertools
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import c, fresh, join_hot, map_frames, slices, tidy, utf8
from voltide.llm.decontaminate import words
from voltide.session import Scratch, spread

TARGETS = ("quality", "toxic")
BINS = 24
#: Bytes to delete to leave all but symbols, digits and capitals; \x80 up are letters.
_SYMBOLS = bytes(b for b in range(128) if not (chr(b).isalnum() or chr(b).isspace() or chr(b) in "_.,;:!?'\"()-"))
_DIGITS, _CAPITALS, _ENDS = b"0123456789", bytes(range(65, 91)), b".!?"
_FORM = ("symbols", "word_length", "distinct", "lines", "digits", "pipes", "capitals", "log_words", "ends", "run", "bigrams", "longest")


def form(text: str | None, w: list[bytes]) -> list[float]:
    """Measures of form of a whole text and its words."""
    raw, n = utf8(text), max(1, len(w))
    size, count = max(1, len(raw)), lambda bytes_: len(raw) - len(raw.translate(None, bytes_))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        count(_SYMBOLS) / size,
        sum(map(len, w)) / n,
        len(set(w)) / n,
        len(set(lines)) / max(1, len(lines)),
        count(_DIGITS) / size,
        raw.count(b"|") / size,
        count(_CAPITALS) / n,
        np.log1p(len(w)),
        count(_ENDS) / n,
        sum(map(operator.eq, w, itertools.islice(w, 1, None))) / n,
        len(set(zip(w, itertools.islice(w, 1, None)))) / n,
        max(map(len, w), default=0),
    ]


#: A feature counts once, twice, and four times over.
LEVELS = (1, 2, 4)
_STEMS = (4, 5, 6, 7, 8)


def parts(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings, as signed 64 bits."""
    all_ = [word, *(word[:n] + b"*" for n in _STEMS if n < len(word))]
    return [h - (1 << 64) if (h := xxhash.xxh3_64_intdigest(x)) >> 63 else h for x in all_]


class _Ids(dict):
    """Word to the ids of its parts that are features; kept up to a bound."""

    def __init__(self, vocab: dict[int, int]):
        self.vocab = vocab

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = tuple(self.vocab[x] for x in parts(word) if x in self.vocab)
        return out


@functools.lru_cache(maxsize=1)
def _ids_of(model: Model) -> _Ids:
    """The word cache of the model in use: one per worker, whatever models
    came before."""
    return _Ids(model.vocab)


@dataclass(eq=False)
class Model:
    """Weights per target; the bin edges of the measures of form."""

    vocab: dict[int, int] = field(default_factory=dict)
    edges: np.ndarray = field(default_factory=lambda: np.zeros((len(_FORM), 0)))
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return len(LEVELS) * len(self.vocab) + len(_FORM) * (BINS + 1)

    def features(self, text: str | None) -> np.ndarray:
        w = words(text)
        hits, n = np.unique(np.fromiter(itertools.chain.from_iterable(map(_ids_of(self).__getitem__, w)), np.int64), return_counts=True)
        base = len(LEVELS) * len(self.vocab)
        bins = [base + k * (BINS + 1) + int(np.searchsorted(e, x)) for k, (x, e) in enumerate(zip(form(text, w), self.edges, strict=True))]
        return np.concatenate([*(len(LEVELS) * hits[n >= least] + k for k, least in enumerate(LEVELS)), np.array(bins, np.int64)])

    def scores(self, text: str | None) -> list[float]:
        f = self.features(text)
        return [float(1 / (1 + np.exp(-np.clip(self.weights[t][f].sum() + self.bias[t], -30, 30)))) if t in self.weights else self.bias[t] for t in TARGETS]


def descend(indptr: np.ndarray, indices: np.ndarray, y: np.ndarray, size: int, rounds: int, l2: float) -> tuple[np.ndarray, float]:
    """Logistic regression on the full sample by L-BFGS with a line search,
    until the gradient is next to nothing or for ``rounds`` rounds. Each row has
    one index at least."""
    rows, n = np.repeat(np.arange(len(y)), np.diff(indptr)), len(y)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.add.reduceat(x[indices], indptr[:-1]) + x[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        g = np.append(np.bincount(indices, err[rows], size), err.sum())
        g[:-1] += l2 * x[:-1] / n
        return float((np.logaddexp(0, z) - y * z).mean() + l2 * (x[:-1] @ x[:-1]) / (2 * n)), g

    x = np.zeros(size + 1)
    x[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-7:
            break
        d, alphas = -g, []
        for s, r in reversed(past):
            alphas.append((s @ d) / (s @ r))
            d = d - alphas[-1] * r
        if past:
            s, r = past[-1]
            d = d * ((s @ r) / (r @ r))
        for (s, r), alpha in zip(past, reversed(alphas), strict=True):
            d = d + s * (alpha - (r @ d) / (s @ r))
        step, slope = (1.0 if past else 1.0 / max(1e-12, np.abs(g).max())), g @ d
        for _ in range(40):
            new, g_new = loss(x + step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (step * d) @ (g_new - g) > 0:
            past = [*past[-9:], (step * d, g_new - g)]
        x, value, g = x + step * d, new, g_new
    return x[:-1], float(x[-1])


def telling_parts(sample: DataFrame, least: int, z: float, most: int) -> list[int]:
    """Hashes of words and beginnings whose share of a target's rows is ``z``
    standard errors off, counted in at least ``least`` rows: for each target the
    most telling ones up to its share of ``most``. Of parts that stand in the
    same rows one is taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 200):
                some = b.iloc[lo : lo + 200]
                found = [np.fromiter({p for x in set(words(t)) for p in parts(x)}, np.int64) for t in some["text"]]
                row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                keys, at = np.unique(np.concatenate(found), return_inverse=True)
                sums = {k: np.bincount(at, v[row], len(keys)).astype(np.int64) for k, v in {"rows": np.ones(len(found)), "same": np.array([zlib.crc32(str(i).encode()) for i in some["label_id"]], float), **{t: some[t].to_numpy(float) for t in TARGETS}}.items()}
                yield pd.DataFrame({"part": keys, **sums})

    names = ["rows", "same", *TARGETS]
    counts = map_frames(sample, run, ", ".join(f"{x} long" for x in ["part", *names])).groupBy("part").agg(*(F.sum(x).alias(x) for x in names)).where(F.col("rows") >= least)
    rate = sample.agg(*(F.avg(t).alias(t) for t in TARGETS)).first()
    out: list[int] = []
    counts = Scratch(sample.sparkSession).table(counts.groupBy(*names).agg(F.min("part").alias("part")), "parts")
    for t in TARGETS:
        if rate[t] is not None and 0 < rate[t] < 1:
            off = F.abs(F.col(t) - rate[t] * F.col("rows")) / F.sqrt(rate[t] * (1 - rate[t]) * F.col("rows"))
            out += [r.part for r in counts.where(off >= z).orderBy(off.desc(), "part").limit(most // len(TARGETS)).collect()]
    return sorted(set(out))


def fit(sample: DataFrame, *, least: int = 5, z: float = 4.0, most_words: int = 20_000, rounds: int = 400, l2: float = 0.2) -> Model:
    """A model of labelled texts (label_id, text, a column per target); features
    are the words that tell (``z``, at most ``most_words``, in at least ``least``
    texts) and the measures of form."""
    model = Model(vocab={x: i for i, x in enumerate(telling_parts(sample, least, z, most_words))})
    plain = [f"x{k}" for k in range(len(_FORM))]

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([form(t, words(t)) for t in b["text"]], columns=plain, dtype=float)

    found = map_frames(sample.select("text"), shapes, ", ".join(f"{x} double" for x in plain)).toPandas()
    if len(found):
        model.edges = np.quantile(found.to_numpy(), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    shipped = sample.sparkSession.sparkContext.broadcast(model)  # bounded by most_words

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(features=[shipped.value.features(t).astype(np.int32) for t in b["text"]])

    schema = "label_id long, " + ", ".join(f"{t} int" for t in TARGETS)
    rows = map_frames(sample.select("label_id", *TARGETS, "text"), sparse, schema + ", features array<int>").toPandas().sort_values("label_id")
    indptr = np.cumsum([0, *map(len, rows["features"])])
    indices = np.concatenate(rows["features"].tolist()) if len(rows) else np.zeros(0, np.int64)
    for t in TARGETS:
        y = rows[t].to_numpy(float)
        if len(y) and 0 < y.sum() < len(y):
            model.weights[t], model.bias[t] = descend(indptr, indices, y, model.size, rounds, l2)
        else:
            model.bias[t] = (y.sum() + 1) / (len(y) + 2)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 12_000, **options) -> Model:
    """Fit on the ``train_rows`` labelled documents of smallest id hash."""
    known = labels.select(c(id_col).cast("long").alias("label_id"), *(c(t).cast("int").alias(t) for t in TARGETS)).na.drop()
    known = known.groupBy("label_id").agg(*(F.max(t).alias(t) for t in TARGETS)).orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows)
    base = docs.select(c(id_col).cast("long").alias("label_id"), c(text_col).cast("string").alias("text"))
    # At most train_rows ids are broadcast; a repeated id is trained on once.
    rows = base.join(F.broadcast(known), "label_id").groupBy("label_id").agg(F.min("text").alias("text"), *(F.first(t).alias(t) for t in TARGETS))
    scratch = Scratch(docs.sparkSession)
    sample = scratch.table(rows, "sample")
    model = fit(sample, **options)
    scratch.free(sample)
    return model


def _logit(x):
    x = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    return F.log(x / (1 - x))


def score(docs: DataFrame, model: Model, text_col: str = "text", *keep: str) -> DataFrame:
    """``keep`` columns and one score per target; one row per row. A text that
    is kept travels once."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by most_words
    sent = docs.select(*map(c, keep), *([] if text_col in keep else [c(text_col)]))
    at, n = sent.columns.index(text_col), len(keep)
    schema = T.StructType([*sent.schema.fields[:n], *(T.StructField(f"score_{t}", T.DoubleType()) for t in TARGETS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for b in slices(batch):
                got = np.array([model.scores(t) for t in b.column(at).cast(pa.string()).to_pylist()]).reshape(-1, len(TARGETS))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(got[:, k]) for k in range(len(TARGETS)))], names=[*keep, *(f"score_{t}" for t in TARGETS)])
        _ids_of(model).clear()  # other stages share this worker's memory
        tidy()

    return spread(sent).mapInArrow(run, schema)


def _shrink(rates: DataFrame, group: str, prior: str, t: str) -> float:
    """Strength of the prior for rates around ``prior``: how many documents it
    is worth, from the spread between groups beyond that of sampling."""
    n, s, p = F.col(f"n_{group}"), F.col(f"{group}_{t}"), F.col(prior)
    rate = s / n
    noise = F.greatest(F.lit(1e-9), F.col(f"{group}_{t}_sq") / n - rate * rate) / n
    weight = n
    r = rates.agg((F.sum(weight * (F.pow(rate - p, 2) - noise)) / F.sum(weight)).alias("spread"), (F.sum(weight * p * (1 - p)) / F.sum(weight)).alias("within")).first()
    if r.spread is None or r.within is None:
        return 1e9
    return float(min(1e9, max(1.0, r.within / max(r.spread, 1e-12) - 1)))


def site_posteriors(scores: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, n_path, post_<target>) for each path, and the global rates.

    ``scores``: host, path, score_<target>, where a path is of one host; sums
    are combined before they move, and a host of many paths is not gathered.
    """
    scratch = Scratch(scores.sparkSession)
    sums = [F.sum(f"score_{t}").alias(f"path_{t}") for t in TARGETS] + [F.sum(F.pow(f"score_{t}", 2)).alias(f"path_{t}_sq") for t in TARGETS]
    paths = scratch.table(scores.groupBy("host", "path").agg(F.count("*").alias("n_path"), *sums), "paths")
    up = [F.sum(f"path_{t}{x}").alias(f"host_{t}{x}") for t in TARGETS for x in ("", "_sq")]
    hosts = scratch.table(paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.count("*").alias("paths"), *up), "hosts")
    total = hosts.agg(F.sum("n_host").alias("n"), *(F.sum(f"host_{t}").alias(t) for t in TARGETS)).first()
    rate = {t: (total[t] or 0.0) / total.n if total.n else 0.5 for t in TARGETS}
    shrunk = hosts
    for t in TARGETS:
        k = _shrink(hosts.withColumn("prior", F.lit(rate[t])), "host", "prior", t)
        shrunk = shrunk.withColumn(f"post_host_{t}", (F.lit(k * rate[t]) + F.col(f"host_{t}")) / (F.col("n_host") + k))
    shrunk = scratch.table(shrunk.select("host", "paths", *(f"post_host_{t}" for t in TARGETS)), "shrunk")
    both = join_hot(paths, shrunk, "host", "paths")
    for t in TARGETS:
        k = _shrink(both, "path", f"post_host_{t}", t)
        both = both.withColumn(f"post_{t}", (k * F.col(f"post_host_{t}") + F.col(f"path_{t}")) / (F.col("n_path") + k))
    return scratch.table(both.select("host", "path", "n_path", *(f"post_{t}" for t in TARGETS)), "posteriors"), rate


def classify(docs: DataFrame, model: Model, *, text_col: str = "text", host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), least_quality: float = 0.5, most_toxic: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, posterior quality and toxicity, and ``kept``; an added
    column gets another name where ``keep`` has it."""
    scratch, held = Scratch(docs.sparkSession), [f"keep{i}" for i in range(len(keep))]
    site = [F.coalesce(c(x).cast("string"), F.lit("")) for x in (host_col, *path_cols)]
    own = held[keep.index(text_col)] if text_col in keep else "text"
    extra = [] if text_col in keep else [c(text_col).cast("string").alias("text")]
    sited = docs.select(*(c(x).alias(k) for x, k in zip(keep, held, strict=True)), *extra, site[0].alias("host"), F.to_json(F.array(*site)).alias("path"))
    scored = scratch.table(score(sited, model, own, *held, "host", "path"), "scored")
    sites, rate = site_posteriors(scored.select("host", "path", *(f"score_{t}" for t in TARGETS)))
    out = join_hot(scored.drop("host"), sites.drop("host"), "path", "n_path")
    for t in TARGETS:
        shift = _logit(F.col(f"post_{t}")) - _logit(F.lit(rate[t]))
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-(_logit(F.col(f"score_{t}")) + shift))))
    good = (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic)
    named = docs.select(*map(c, keep))
    return out.select(*(c(k).alias(x) for x, k in zip(keep, held, strict=True)), *(F.col(f"p_{t}").alias(fresh(named, f"p_{t}")) for t in TARGETS), good.alias(fresh(named, "kept")))


def keep_good(docs: DataFrame, model: Model, **options) -> DataFrame:
    """The documents that are kept, with all their columns."""
    judged = classify(docs, model, keep=tuple(docs.columns), **options)
    return judged.where(c(judged.columns[-1])).select(*map(c, docs.columns))
