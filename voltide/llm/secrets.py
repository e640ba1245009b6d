"""Secret scan: keyword automaton, anchored patterns near hits, checksums.

One Aho-Corasick pass over the lower-cased text finds keywords. Patterns are
tried only where a keyword starts, in order and without overlap within a kind,
so the spans are those of a leftmost scan of the whole text. Runs of hex digits
have no keyword; one linear scan finds them. Tokens that carry a checksum of
their own count only if it holds.

Kinds, in the order used for ties: assign, access, hex, github, npm.

Defined results: null and empty texts have no spans; every row is kept, repeated
rows, null ids and ties too; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from voltide.llm.common import c, map_frames
from voltide.session import spread

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "github", "npm")
#: Published token formats: a prefix, 30 random letters and 6 of base-62 CRC-32.
CHECKED = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
KEYWORDS = {**dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"), "akia": "access", **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"), "npm_": "npm"}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {i: i + 32 for i in range(65, 91)}
SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def checksum62(body: str) -> str:
    """CRC-32 of the letters, in base 62, six digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def _try(kind: str, text: str, at: int):
    """(end, counts) of the match that starts at ``at``, or None."""
    if kind == "assign":
        return (m.end(), len(m[2]) >= ASSIGN_LEAST) if (m := ASSIGN.match(text, at)) else None
    if kind == "access":
        return (m.end(), m.end() - at >= ACCESS_LEAST) if (m := ACCESS.match(text, at)) else None
    return (m.end(), checksum62(m[1]) == m[2]) if (m := CHECKED[kind].match(text, at)) else None


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift offsets
        low = text.translate(_LOWER)
    out, past, hits = [], {}, []
    for last, (n, kind) in _automaton().iter(low):
        hits.append((last + 1 - n, kind))
    for at, kind in sorted(hits):
        if at >= past.get(kind, 0) and (found := _try(kind, text, at)):
            past[kind] = found[0]
            if found[1]:
                out.append((at, found[0], kind))
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of each whole text; one row per input row, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                spans = find_spans(t)
                base = [s for s in spans if s[2] in KINDS[:3]]
                kinds = [s[2] for s in base]
                rows.append((None if pd.isna(d) else int(d), *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(render(base).encode()).hexdigest(), render(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], dtype=object)

    return map_frames(spread(docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text"))), run, SPANS)


def redact_text(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans as one."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, e, _ in spans:
        if s >= end:
            out += [text[at:s] if end < 0 else text[end:s], mask]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, *, text_col: str = "text", n_chars_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """Every row and column of ``docs``, secrets masked; ``n_chars_col``, where
    there is one, follows the new length of changed texts."""
    schema, at = docs.schema, docs.columns.index(text_col)
    size_at = docs.columns.index(n_chars_col) if n_chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [redact_text(t, mask) for t in old]
            if new != old:
                cols = list(b.columns)
                cols[at] = pa.array(new, b.schema.field(at).type)
                if size_at is not None:
                    sizes = b.column(size_at).to_pylist()
                    cols[size_at] = pa.array([s if n is o or n == o else len(n) for s, n, o in zip(sizes, new, old, strict=True)], b.schema.field(size_at).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return spread(docs).mapInArrow(run, schema)
