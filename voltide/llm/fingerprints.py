"""Canonical exact digests, with DataFrame and SQL functions alone.

A text is folded to a canonical form: Unicode NFKC, full case folding, NFKC
again, runs of white space to one space, ends trimmed. (ICU, which Spark ships,
does both Unicode steps through the built-in ``java_method``; for ASCII texts
they equal ``lower``.) Two 64-bit xxhashes under different seeds make a wide
digest. Where a digest is shared, the canonical bytes are compared through the
smallest and the largest text of the bucket, which partial aggregation finds
before anything moves; if they differ, the bucket's texts are numbered and the
number becomes part of the fingerprint. So fingerprints are equal exactly when
canonical texts are.

Neighbours in ascending order of (id, text hash) are found without a global
sort: ids are cut into many ranges at approximate quantiles, a window runs in
each, and the first row of every range also goes to the range before, as its
last successor. An id that fills a range by itself is cut by text hash, and equal
rows that do by chance, so that no task holds all rows of one id.

Defined results: a null text is empty; a null id sorts first; rows that repeat
an id are ordered by text hash; equal rows may follow each other; the successor
of the last row is the first; in a table of one row it is the row itself; a very
long text is folded in the task that holds it; an empty table gives no rows;
other columns are not read. Likeness of exact digests is 1 or 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.llm.common import broadcast_if_small, c
from voltide.session import Scratch

#: Bounds in one level of ranges, and rows that a range should have.
FAN, RANGE_ROWS = 512, 500


def _icu(cls: str, method: str, text: Column) -> Column:
    return F.call_function("java_method", F.lit(f"com.ibm.icu.{cls}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    nfkc = lambda x: _icu("text.Normalizer", "compose", x)
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(nfkc(_icu("lang.UCharacter", "foldCase", nfkc(text))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_digest(canon: Column) -> Column:
    """32 hex digits: two xxhashes under different seeds."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(half("voltide-a"), half("voltide-b"))


def _below(marks: Column, x: Column, most: int = FAN) -> Column:
    """How many of an ascending array's values are at most ``x``: a binary
    search, in steps of powers of two."""
    steps = F.array(*(F.lit(1 << k) for k in range(max(1, most).bit_length() - 1, -1, -1)))
    fits = lambda n: (n <= F.size(marks)) & (F.try_element_at(marks, n) <= x)
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(fits(n + s), n + s).otherwise(n))


def _ranges(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A way to add to rows (key, tie) a struct ``range`` that ascends with them.
    What it depends on is written, so that it always places a row alike.

    Bounds are approximate quantiles of the key; beyond FAN ranges, each range
    is cut again by its own bounds, whose table has at most FAN rows. Keys of
    over twice a range's rows, at most one for two ranges, get ranges of their
    own, cut by the tie; so do hot (key, tie) pairs, cut by chance."""
    scratch, total = Scratch(rows.sparkSession), rows.count()
    ranges = min(FAN * FAN, max(1, total // RANGE_ROWS))
    upper, share = min(FAN, ranges), 2 * max(RANGE_ROWS, total // ranges)
    bounds = lambda n: F.percentile_approx("key", F.array(*(F.lit(i / n) for i in range(1, n))), 20 * FAN) if n > 1 else F.array().cast("array<long>")
    marks = lambda xs: F.array_sort(F.array_distinct(xs))
    cut = sorted(set(rows.agg(bounds(upper).alias("b")).first().b or []))
    coarse = lambda df: df.withColumn("coarse", _below(F.array(*map(F.lit, cut)).cast("array<long>"), F.col("key")) if cut else F.lit(0))
    fine = scratch.table(coarse(rows).groupBy("coarse").agg(marks(bounds(-(-ranges // FAN))).alias("marks")), "bounds")
    placed = lambda df: coarse(df).join(F.broadcast(fine), "coarse").withColumn("fine", _below(F.col("marks"), F.col("key"))).drop("marks")

    pairs = scratch.table(placed(rows).groupBy("coarse", "fine", "key", "tie").agg(F.count("*").alias("n")).groupBy("coarse", "fine", "key").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("n") > share, F.col("tie")))).alias("ties"), F.max("n").alias("most")).where(F.col("n") > share), "hot")
    hot = scratch.table(pairs.groupBy("coarse", "fine").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.struct("n", "ties", "most").alias("v"))))).alias("hot")), "hot_by_range")
    known = F.coalesce(F.map_keys("hot"), F.array().cast("array<long>"))
    own = F.try_element_at(F.col("hot"), F.col("key"))
    parts = F.ceil(own["n"] / share).cast("double")
    by_tie = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * parts).cast("int")
    many = F.array_contains(own["ties"], F.col("tie"))
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(own["most"] / share))
    zero = F.lit(0)
    place = F.struct(
        "coarse",
        "fine",
        (_below(known, F.col("key"), 1 << 20) * 2 + F.when(own.isNotNull(), 0).otherwise(1)).alias("group"),
        F.coalesce(by_tie, zero).alias("slice"),
        F.coalesce(_below(own["ties"], F.col("tie"), 1 << 20) * 2 + F.when(many, 0).otherwise(1), zero).alias("repeat"),
        F.when(F.coalesce(many, F.lit(False)), chance).otherwise(F.lit(0).cast("long")).alias("part"),
    )
    return lambda df: placed(df).join(F.broadcast(hot), ["coarse", "fine"], "left").withColumn("range", place).drop("coarse", "fine", "hot")


def with_successor(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, key, text, next_key, next_text, digest, next_digest): each row
    with the row after it in ascending order of id and text hash."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(c(text_col).cast("string"), F.lit(""))
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), F.coalesce(c(id_col).cast("long"), F.lit(-(2**63))).alias("key"), text.alias("text"), F.xxhash64(text).alias("tie"))
    place = _ranges(rows.select("key", "tie"))
    slim = scratch.table(place(rows.select("key", "tie")).groupBy("range").agg(F.min(F.struct("key", "tie")).alias("first")), "firsts")
    # Each range's first row goes to the range before, the first of all to the last.
    order = Window.orderBy("range")
    wrap = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edge = scratch.table(slim.select("range", F.coalesce(F.lead("first").over(order), wrap).alias("follows")), "edges")
    follows = edge.select("range", F.col("follows.key").alias("f_key"), F.col("follows.tie").alias("f_tie"))
    met = rows.join(F.broadcast(follows), (F.col("key") == F.col("f_key")) & (F.col("tie") == F.col("f_tie")))
    # Rows that are equal in both stand for each other: one is taken, before any of them moves.
    ghosts = met.groupBy("range").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("tie").alias("tie"), F.first("text").alias("text")).withColumn("ghost", F.lit(1))
    both = place(rows).withColumn("ghost", F.lit(0)).unionByName(ghosts)
    both = both.withColumn("digest", digest(canonical(F.col("text"))))
    w = Window.partitionBy("range").orderBy("ghost", "key", "tie")
    out = both.withColumns({f"next_{x}": F.lead(x).over(w) for x in ("key", "text", "digest")})
    return out.where("ghost = 0").drop("ghost", "tie", "range")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the
    following text (or all it has)."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def bucket_numbers(members: DataFrame) -> DataFrame | None:
    """(kind, key, digest, number) of members (kind, key, digest, canon) whose
    bucket holds different texts; None where no bucket does."""
    scratch = Scratch(members.sparkSession)
    mixed = members.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low != high")
    mixed = scratch.table(mixed.select("digest"), "mixed")
    if not mixed.limit(1).count():
        return None
    split = members.join(broadcast_if_small(mixed), "digest", "left_semi")
    texts = split.groupBy("digest", "canon").agg(F.count("*").alias("n"))
    numbered = texts.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1)
    return scratch.table(split.join(numbered, ["digest", "canon"]).groupBy("kind", "key", "digest").agg(F.max("number").alias("number")), "numbers")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = wide_digest) -> DataFrame:
    """Fingerprints of each text and of its edited text; see the module's text.

    ``digest`` may be replaced, as tests of equal buckets do."""
    scratch = Scratch(docs.sparkSession)
    pairs = with_successor(docs, id_col, text_col, digest).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("edited_digest", digest(canonical(F.col("edited"))))
    like = lambda a, b, x, y: F.when(F.col(a) == F.col(b), F.when(canonical(F.col(x)) == canonical(F.col(y)), 1.0).otherwise(0.0)).otherwise(0.0)
    table = scratch.table(
        pairs.select("doc_id", "key", "next_key", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "digest", "edited_digest", like("digest", "edited_digest", "text", "edited").alias("near_edited"), like("digest", "next_digest", "text", "next_text").alias("near_next")),
        "digests",
    )
    shared = table.select(F.explode(F.array("digest", "edited_digest")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    shared = scratch.table(shared, "shared")

    text = F.coalesce(c(text_col).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(c(id_col).cast("long"), F.lit(-(2**63))).alias("key"), text.alias("text"))
    own = base.withColumn("canon", canonical(F.col("text"))).withColumn("digest", digest(F.col("canon")))
    own = own.join(broadcast_if_small(shared), "digest", "left_semi").select(F.lit(0).alias("kind"), "key", "digest", "canon")
    again = table.where("edited_digest != digest or near_edited = 0").select("key", "next_key", "edited_digest")
    again = scratch.table(again.join(broadcast_if_small(shared.withColumnRenamed("digest", "edited_digest")), "edited_digest", "left_semi").distinct(), "again")
    members = own
    if again.limit(1).count():
        texts = base.join(broadcast_if_small(again.select("key").union(again.select("next_key")).distinct()), "key", "left_semi")
        edits = again.join(texts, "key").join(texts.select(F.col("key").alias("next_key"), F.col("text").alias("next_text")), "next_key")
        edits = edits.withColumn("canon", canonical(edited_text(F.col("text"), F.col("next_text")))).where(digest(F.col("canon")) == F.col("edited_digest"))
        members = own.unionByName(edits.select(F.lit(1).alias("kind"), "key", F.col("edited_digest").alias("digest"), "canon"))
    numbers = bucket_numbers(members)
    if numbers is not None:
        for kind, name in ((0, "digest"), (1, "edited_digest")):
            own_numbers = numbers.where(F.col("kind") == kind).select("key", F.col("digest").alias(name), "number")
            table = table.join(own_numbers, ["key", name], "left")
            table = table.withColumn(name, F.when(F.coalesce("number", F.lit(0)) > 0, F.concat(name, F.lit("-"), "number")).otherwise(F.col(name))).drop("number")
        table = table.withColumn("edited_digest", F.when(F.col("near_edited") == 1, F.col("digest")).otherwise(F.col("edited_digest")))
    return table.select("doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
