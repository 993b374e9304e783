"""Line dedup: maximal repeated runs of lines, found over line-ID sequences by prefix doubling.

Texts become sequences of line IDs. Names for all runs of 2 ** j lines are made by prefix doubling:
the name of a run is made from the names of its two halves. The suffixes of all sequences are then
sorted into the intervals of the suffix array, the longest blocks first: suffixes that share what
they have shared so far, and the name of their next 2 ** j lines, form an interval whose longest
common prefix is that much longer. Each interval goes on with its own next blocks, while its first
suffix (in corpus order) also stays in the interval it came from and stands there for all of it.
After the single lines, every suffix has met, level by level, the earliest suffix of each interval
it lies in; the longest prefix that it shares with an earlier suffix is then known exactly. Such a
prefix of at least MIN_WORDS words is a later copy of a run, and its lines are deleted; the first
copy stays. An interval's size and first suffix are combined in each task before they are shuffled,
so a line, run or text that is everywhere is a row a task.

Only what can matter is sorted: equal texts are one sequence (later documents with it are copies
from end to end), and a sequence is a stretch of lines that each occur twice or more, with at least
MIN_WORDS words. Line IDs and the names of longer runs have 128 bits; whether a line occurs twice is
first asked of 64 of them, which only lets more lines in.

Lines and intervals are joined with what is known of them by their names. A name that stands for
more than a share of 1 / SHARES of the rows (and FEW rows) is dealt to as many parts as it has such shares, so a
line that is everywhere is spread over the tasks; fewer than SHARES names can be so common.

Corpus order is by doc_id, null last, then by the text's digest, then by line. Lines are what
newlines separate; an empty line is a line of no words.

Runs below MIN_WORDS words stay however often they recur: headings, list items and idioms are no
copies. Defined results: a null text is empty, one line without words. Rows with equal doc_id and text are
one document: each of them gets the same result. Runs may repeat within a document. Documents of
which nothing is left are dropped by deduplicated(). Only doc_id and text are read (and n_chars
written, if there is such a column), so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

#: Fewest words of a run that is deleted where it occurs again.
MIN_WORDS = 50
#: A key with more than this part of the rows of a join is split, but not one with so few rows.
SHARES, FEW = 1000, 2000

LINES = "struct<h:array<long>,g:array<long>,w:array<int>>"
SEGMENT = "x boolean, doc_id string, own binary, at int, w array<int>, r array<int>, a array<long>, b array<long>"


def line_ids(text: str) -> Column:
    """A column with both halves of the ID and the number of words of each line."""

    @F.pandas_udf(LINES)
    def of(texts: pd.Series) -> pd.DataFrame:
        h, g, w = [], [], []
        for t in texts:
            lines = (t or "").encode("utf-8", "surrogatepass").split(b"\n")
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").astype(np.int64)
            g.append(both[::2])
            h.append(both[1::2])
            w.append([len(x.split()) for x in lines])
        return pd.DataFrame({"h": h, "g": g, "w": w})

    return of(F.col(text))


def joined_evenly(rows: DataFrame, found: DataFrame, keys: list[str], spread: Column, how: str) -> DataFrame:
    """rows joined with found (a row for each key, n: how many of rows have it). Common keys are dealt to several parts.

    A key with more than FEW rows and more than a share of 1 / SHARES of all n is split by the hash
    spread; fewer than SHARES keys can be, so their list is bounded and is broadcast.
    """
    total, most = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    part = max(FEW, total // SHARES)
    if most <= part:
        return rows.join(found, keys, how)
    hot = found.where(F.col("n") > part).select(*keys, F.ceil(F.col("n") / part).alias("parts")).collect()
    kind = ", ".join([*(f"{k} {found.schema[k].dataType.simpleString()}" for k in keys), "__parts long"])
    split = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in hot], kind))
    left = rows.join(split, keys, "left").withColumn("__part", F.coalesce(F.pmod(spread, F.col("__parts")), F.lit(0).cast("long"))).drop("__parts")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1).cast("long")) - 1))
    right = found.join(split, keys, "left").withColumn("__part", each).drop("__parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit name for each pair of names."""
    x = (a ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = (x + b) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The length of each list of a column, and the values of all lists behind each other."""
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def members(values: pa.Array) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False) for x in values.flatten()]


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of neighbouring repeated lines with MIN_WORDS words or more; rows: a text's repeated lines in order.

    doc_id travels as text, so that numbers with nulls beside them stay exact."""
    for batch in batches:
        sizes, lines = flat(batch["lines"])
        if not len(lines):
            continue
        i, h, g, w = members(lines)
        row, w = np.repeat(np.arange(len(sizes)), sizes), w.astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero((np.diff(i) != 1) | (np.diff(row) != 0)) + 1])
        length, total = np.diff(np.append(start, len(i))), np.add.reduceat(w, start)
        before = np.cumsum(w) - w
        left = np.repeat(total + before[start], length) - before
        keep = total >= MIN_WORDS
        inside = np.repeat(keep, length)
        offsets = pa.array(np.concatenate([[0], np.cumsum(length[keep])]), pa.int32())

        def lists(values: np.ndarray, kind: pa.DataType, inside: np.ndarray = inside, offsets: pa.Array = offsets) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, pa.array(values[inside], kind))

        of = pa.array(row[start[keep]])
        columns = [*(batch[c].take(of) for c in ("x", "doc_id", "own")), pa.array(i[start[keep]], pa.int32()), lists(w, pa.int32()), lists(left, pa.int32()), lists(h, pa.int64()), lists(g, pa.int64())]
        yield pa.record_batch(columns, ["x", "doc_id", "own", "at", "w", "r", "a", "b"])


def names(a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the runs of 2 ** level lines at each line at which one fits, by prefix doubling.

    The sequences of a batch stand behind each other; a name that goes over an end is one that nobody asks for."""
    a, b, size = a.view(np.uint64), b.view(np.uint64), 1
    for _ in range(level):
        if len(a) <= size:
            return a[:0], b[:0]
        a, b, size = mixed(a[:-size], a[size:], 1), mixed(b[:-size], b[size:], 2), size * 2
    return a, b


def candidates(level: int):
    """For mapInArrow: rows (uid, a, b, states) to the states with the interval (k1, k2) that their next 2 ** level lines lead to, if so many are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a = flat(batch["a"])
            counts, states = flat(batch["states"])
            na, nb = names(a.to_numpy(zero_copy_only=False), batch["b"].flatten().to_numpy(zero_copy_only=False), level)
            p, cur, c1, c2, best = members(states)
            row, at = np.repeat(np.arange(len(counts)), counts), p + cur
            fits = at + (1 << level) <= sizes[row]
            here = ((np.cumsum(sizes) - sizes)[row] + at)[fits]
            k1, k2 = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            k1[fits] = mixed(c1[fits].view(np.uint64), na[here], 5 + level).view(np.int64)
            k2[fits] = mixed(c2[fits].view(np.uint64), nb[here], 105 + level).view(np.int64)
            columns = [batch["uid"].take(pa.array(row)), *map(pa.array, (p, cur, c1, c2, best, fits, k1, k2))]
            yield pa.record_batch(columns, ["uid", "p", "cur", "c1", "c2", "best", "fits", "k1", "k2"])

    return run


STATE = "uid long, p long, cur long, c1 long, c2 long, best long"


def shared_prefixes(sequences: DataFrame) -> DataFrame:
    """(uid, p, best): the lines that the suffix at p of sequence uid shares with an earlier suffix.

    sequences: uid (a long that rises in corpus order), a and b (halves of line IDs), r (words from each line on).
    """
    longest = sequences.agg(F.max(F.size("a"))).first()[0] or 0
    # a suffix with fewer than MIN_WORDS words left can't be part of any run
    states = sequences.select("uid", F.posexplode("r").alias("p", "left")).where(F.col("left") >= MIN_WORDS).withColumn("p", F.col("p").cast("long"))
    zero = F.lit(0).cast("long")
    states = states.select("uid", "p", zero.alias("cur"), zero.alias("c1"), zero.alias("c2"), zero.alias("best"))
    for level in reversed(range(max(1, int(longest)).bit_length())):
        by = states.groupBy("uid").agg(F.collect_list(F.struct("p", "cur", "c1", "c2", "best")).alias("states"))
        tried = by.join(sequences.select("uid", "a", "b"), "uid").select("uid", "a", "b", "states").mapInArrow(candidates(level), f"{STATE}, fits boolean, k1 long, k2 long")
        tried = checkpoint(tried.withColumn("place", F.col("uid").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("p").cast("decimal(20,0)")))
        met = checkpoint(tried.where("fits").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1"))
        inner = joined_evenly(tried.where("fits"), met, ["k1", "k2"], F.xxhash64("uid", "p"), "left")
        more = (F.col("cur") + (1 << level)).alias("cur")
        on = inner.where("n is not null").select("uid", "p", more, F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.when(F.col("place") > F.col("first"), F.greatest("best", F.col("cur") + (1 << level))).otherwise(F.col("best")).alias("best"))
        stay = inner.where("n is null or place = first").select("uid", "p", "cur", "c1", "c2", "best")
        states = tried.where("not fits").select("uid", "p", "cur", "c1", "c2", "best").unionByName(stay).unionByName(on)
    return states.groupBy("uid", "p").agg(F.max("best").alias("best")).where("best > 0")


def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line ranges that go; rows: a sequence with its shared prefixes."""
    for batch in batches:
        sizes, words = flat(batch["w"])
        counts, found = flat(batch["found"])
        p, n = members(found)
        # every sequence has a place more than lines, so that a range can end behind its last line
        base = np.cumsum(sizes + 1) - (sizes + 1)
        before = np.zeros(int((sizes + 1).sum()), np.int64)
        before[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = words.to_numpy(zero_copy_only=False)
        before = np.cumsum(before)
        start = np.repeat(base, counts) + p
        enough = before[start + n] - before[start] >= MIN_WORDS
        gone = np.zeros(len(before), np.int64)
        np.add.at(gone, start[enough], 1)
        np.add.at(gone, (start + n)[enough], -1)
        step = np.diff((np.cumsum(gone) > 0).astype(np.int8), prepend=0)
        first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        of = np.searchsorted(base, first, "right") - 1
        shift = batch["at"].to_numpy(zero_copy_only=False)[of] - base[of]
        yield pa.record_batch([batch["own"].take(pa.array(of)), pa.array(first + shift, pa.int32()), pa.array(end + shift, pa.int32())], ["own", "start", "end"])


def marks(docs: DataFrame) -> DataFrame:
    """For every different (doc_id, text): doc_id, own (the text's digest), n_lines, n_words, and the ranges (start, end) of lines to delete."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    slim = checkpoint(docs.select("doc_id", F.unhex(F.md5(text)).alias("own"), line_ids("text").alias("l")).select("doc_id", "own", "l.*"))
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id")
    first = slim.groupBy("own").agg(F.min(order).alias("o"))
    # equal texts are one sequence: lines of the first document with it
    whole = slim.groupBy("own").agg(F.first(F.struct("h", "g", "w")).alias("l"), F.min(order).alias("o")).select("own", F.col("o.x").alias("x"), F.col("o.doc_id").alias("doc_id"), "l.*")
    whole = checkpoint(whole.where(F.aggregate("w", F.lit(0), lambda s, x: s + x) >= MIN_WORDS))
    again = checkpoint(whole.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    lines = whole.select("x", "doc_id", "own", F.posexplode(F.arrays_zip("h", "g", "w")).alias("i", "l")).select("x", "doc_id", "own", "i", "l.*")
    rows = joined_evenly(lines, again, ["h"], F.xxhash64("own", "i"), "inner")
    rows = rows.groupBy("x", "doc_id", "own").agg(F.sum("w").alias("s"), F.sort_array(F.collect_list(F.struct("i", "h", "g", "w"))).alias("lines"))
    rows = rows.where(F.col("s") >= MIN_WORDS).select("x", F.col("doc_id").cast("string").alias("doc_id"), "own", "lines").mapInArrow(segments, SEGMENT)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    # a number that rises in corpus order, fixed by the checkpoint
    sequences = checkpoint(rows.orderBy("x", "doc_id", "own", "at").withColumn("uid", F.monotonically_increasing_id()))
    prefixes = shared_prefixes(sequences.select("uid", "a", "b", "r")).groupBy("uid").agg(F.collect_list(F.struct("p", "best")).alias("found"))
    gone = prefixes.join(sequences.select("uid", "own", "at", "w"), "uid").select("own", "at", "w", "found").mapInArrow(deleted, "own binary, start int, end int")
    gone = gone.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    each = slim.select("doc_id", "own", F.size("w").alias("n_lines"), F.aggregate("w", F.lit(0), lambda s, x: s + x).alias("n_words")).distinct()
    each = each.join(first, "own", "left").join(gone, "own", "left")
    shape = "array<struct<start:int,end:int>>"
    copy = ~F.col("doc_id").eqNullSafe(F.col("o.doc_id"))
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("end"))).cast(shape)
    ranges = F.when(copy & (F.col("n_words") >= MIN_WORDS), everything).otherwise(F.coalesce("ranges", F.array().cast(shape)))
    return each.select("doc_id", "own", "n_lines", "n_words", ranges.alias("ranges"))


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted and deleted (line ranges, the end exclusive) of every row."""
    keys = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("own"))
    found = marks(docs).withColumnsRenamed({"doc_id": "__id", "own": "__own"})
    rows = keys.join(found, (F.col("own") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    count = F.aggregate("ranges", F.lit(0), lambda s, r: s + r["end"] - r["start"]).cast("long")
    listed = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), count.alias("n_deleted"), listed.alias("deleted"))


def kept_text(text: Column, ranges: Column) -> Column:
    """A text without the lines in the ranges."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, ranges, strict=True):
            lines, at, kept = (t or "").split("\n"), 0, []
            for r in found:
                kept += lines[at : r["start"]]
                at = r["end"]
            out.append("\n".join(kept + lines[at:]))
        return pd.Series(out, dtype=object)

    return cut(text, ranges)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without the lines of later copies; a document of which nothing is left is dropped."""
    found = marks(docs).where(F.size("ranges") > 0).select(F.col("doc_id").alias("__id"), F.col("own").alias("__own"), F.col("ranges").alias("__ranges"), F.col("n_lines").alias("__n"))
    whole = (F.size("__ranges") == 1) & (F.col("__ranges")[0]["start"] == 0) & (F.col("__ranges")[0]["end"] == F.col("__n"))
    rows = docs.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = rows.join(found, (F.col("__key") == F.col("__own")) & rows["doc_id"].eqNullSafe(F.col("__id")), "left").where(F.col("__ranges").isNull() | ~whole)
    text = F.when(F.col("__ranges").isNull(), F.col("text")).otherwise(kept_text(F.when(F.col("__ranges").isNotNull(), F.col("text")), F.coalesce("__ranges", F.array().cast("array<struct<start:int,end:int>>"))))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__ranges").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)
