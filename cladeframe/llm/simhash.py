"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits, each set if it is set in over half of the XXH64 hashes of the
text's three-word shingles. Fingerprints link at DISTANCE or fewer differing bits. Cut into two
halves, two linked fingerprints have a half in which they differ by one bit at most; so each half is
indexed under its 32 one-wildcard variants (one bit deleted), equal variants are joined, and the
distance is verified. Only distinct fingerprints are indexed, so copies cost nothing here.

A variant's bucket is counted before its members are brought together. One with more than CAP
members is cut again: the other half into two quarters, and then the last quarter into two eighths,
with one-wildcard variants of their own. After the second cut a bucket holds at most 2048 distinct
fingerprints, whatever the data, so no link is lost and no task grows. A bucket yields a spanning
forest of its links, not all pairs.

Defined results: a null or empty text has the fingerprint zero and links like any other. Repeated
rows share fingerprint and component. A row without doc_id belongs to its component but doesn't
name it; if no row has one, the name is null. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Most fingerprints that one bucket brings together before it is cut again.
CAP = 4096


def fingerprint(text: str) -> int:
    """The fingerprint of a text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(text: str) -> Column:
    """Fingerprints of a column of texts, as signed longs."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64))

    return of(F.col(text))


def variants(value: Column, bits: int, parts: int) -> Column:
    """All one-wildcard variants of the parts of a value of so many bits: part and wildcard, then the part with that bit deleted."""
    size = bits // parts
    mask = (1 << size) - 1

    def variant(i: Column) -> Column:
        part = F.floor(i / size).cast("int")
        bit = (i % size).cast("int")
        cut = F.call_function("shiftrightunsigned", value, part * size).bitwiseAND(F.lit(mask))
        return i.cast("long") * F.lit(1 << size) + cut.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))

    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), variant))


def other(key: str, value: Column, bits: int) -> Column:
    """The part of a value of so many bits that the key of a two-part cut doesn't cover."""
    size = bits // 2
    part = F.floor(F.col(key) / (size << size)).cast("int")
    return F.call_function("shiftrightunsigned", value, (1 - part) * size).bitwiseAND(F.lit((1 << size) - 1))


def bucketed(members: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """Members (keys, fp) of buckets with two members or more, each with its bucket's size n, and whether one is over CAP."""
    sizes = checkpoint(members.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    return members.join(sizes, keys), most > CAP


def bucket_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints (unsigned, distinct)."""
    n = len(fps)
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for at in range(0, n, 256):
        near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= DISTANCE
        for a, b in zip(*np.nonzero(near), strict=True):
            if (a := int(a) + at) < b and (x := root(a)) != (y := root(int(b))):
                parent[y] = x
                out.append((a, int(b)))
    return out


def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        u, v = [], []
        for fps in batch.fps:
            signed = np.asarray(fps, np.int64)
            for a, b in bucket_links(signed.view(np.uint64)):
                u.append(signed[a])
                v.append(signed[b])
        yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect what is connected among the distinct fingerprints fps (fp), by signatures."""
    spark = fps.sparkSession
    small_batches(spark)
    found, keys = [], ["k1"]
    members = fps.select("fp", variants(F.col("fp"), 64, 2).alias("k1"))
    while True:
        members, hot = bucketed(members, keys)
        hot = hot and len(keys) < 3  # after the second cut a bucket is bounded by the bits that are left
        groups = (members.where(F.col("n") <= CAP) if hot else members).groupBy(*keys).agg(F.collect_list("fp").alias("fps")).select("fps")
        found.append(groups.mapInPandas(linked, "u long, v long"))
        if not hot:
            break
        rest = members.where(F.col("n") > CAP).drop("n")
        if len(keys) == 1:
            members = rest.select("k1", "fp", variants(other("k1", F.col("fp"), 64), 32, 2).alias("k2"))
            keys = ["k1", "k2"]
        else:
            last = other("k2", other("k1", F.col("fp"), 64), 32)
            members = rest.select("k1", "k2", "fp", variants(last, 16, 2).alias("k3"))
            keys = ["k1", "k2", "k3"]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def classes(slim: DataFrame) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of slim (doc_id, fp)."""
    fps = checkpoint(slim.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(fps.select("fp")))
    joined = fps.join(found, fps.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    joined = checkpoint(joined)
    named = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    return joined.join(named, "c").select("fp", "component_id")


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    small_batches(docs.sparkSession)
    slim = checkpoint(docs.select("doc_id", fingerprints("text").alias("fp")))
    out = slim.join(classes(slim), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest doc_id (null last, then by hash of the text)."""
    small_batches(docs.sparkSession)
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    slim = checkpoint(docs.select("doc_id", own.alias("__own"), fingerprints("text").alias("fp")))
    fps = slim.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "__own")).alias("first"))
    fps = checkpoint(fps)
    found = components(links(fps.select("fp")))
    best = fps.join(found, fps.fp == found.node, "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("first").alias("first"))
    copies = slim.groupBy("doc_id", "__own").agg(F.count("*").alias("__n"))
    stay = best.select("first.doc_id", "first.__own").distinct()
    stay = stay.join(copies, stay["doc_id"].eqNullSafe(copies["doc_id"]) & (stay["__own"] == copies["__own"])).select(stay["doc_id"].alias("__id"), stay["__own"].alias("__hash"), "__n")
    rows = docs.withColumn("__own", own)
    rows = rows.join(stay, (rows["__own"] == F.col("__hash")) & rows["doc_id"].eqNullSafe(F.col("__id")))
    # repeated rows of one doc_id and text: one of them stays
    one, more = rows.where("__n = 1"), rows.where("__n > 1").dropDuplicates(["__id", "__hash"])
    return one.unionByName(more).select(*docs.columns)
