"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks.

Each source's documents are permuted by a seeded hash and cut into blocks of that permutation. A
source's target fixes how many whole passes over the source the mix takes and how many further
blocks: an exact quota. A binary tree over the output shards splits the quotas of all sources at
once: at each node, the number of blocks that the left half gets from each source is drawn from the
multivariate hypergeometric distribution given the node's quotas and the left half's share of
blocks. At the leaves each shard draws its quota of disjoint consecutive blocks of the permutation,
and shuffles locally, by a hash of its own.

The block in which a target ends is taken in part: of its documents, the largest that still fits is
taken until none does. Words that are then still missing (where a document is larger than a block's
others together) are taken from the blocks after it, of the documents that fit, in the same way,
until the rest is under CLOSE of the target or no document fits.

The number of shards grows with the mix: one for SHARD_WORDS words, LEAST_SHARDS at least.

Sources are ordered by code point, null last, and get the weights 3, 1, 2, repeating. They share
TOTAL times the words of all; no target exceeds MOST times its source's words, and what is above is
shared again by weight among the others.

Defined results: a null text has no words; a row without words is in a mix only as part of its
block. Rows with equal doc_id and equal words share one fate. An empty table gives an empty mix.
Other columns pass through; names that begin with two underscores are used inside. Everything is
drawn from hashes and seeds, so reruns and lost executors give the same mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint

#: Fixed weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and most words taken for each word of a source.
TOTAL, MOST = 1.5, 2.0
#: Mean documents in a block, blocks that are summed together first, seed.
BLOCK, WIDE, SEED = 1024, 4096, 11
#: Words of the mix in a shard, and the fewest shards.
SHARD_WORDS, LEAST_SHARDS = 8_000_000, 4
#: A target is filled until no more than this share of it is open.
CLOSE = 0.0005
#: The per-source tables live on the driver; more sources than this are refused, and shards are made larger
#: where sources times shards would exceed CELLS.
MAX_SOURCES, CELLS = 100_000, 2_000_000
#: Most keys of documents taken from cut blocks that are broadcast; beyond, they are joined by a shuffle.
MAX_KEYS = 1_000_000
#: Ranges of a source that are looked through at once when a block's shard is found.
RANGES = 32
#: The column that holds a row's place in the permutation.
KEY = "__key"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> list[float]:
    """Target words of each source, given in order."""
    w = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    left, open_, out = total * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = left / sum(w[k] for k in open_)
        full = {k for k in open_ if share * w[k] > most * sizes[k]}
        if not full:
            for k in open_:
                out[k] = share * w[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ -= full
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); the columns sum to the quotas."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    take = int(quotas.sum()) * half // shards
    left = draw(quotas, take, rng)
    return np.vstack([split(left, half, rng), split(quotas - left, shards - half, rng)])


def hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """One hypergeometric draw by inversion, for numbers of any size.

    The probabilities follow from their exact ratios, outwards to twelve deviations from the mode:
    what lies beyond is far below the resolution of the uniform number.
    """
    low, high, n = max(0, sample - bad), min(good, sample), good + bad
    if low == high:
        return low
    mode = (sample + 1) * (good + 1) // (n + 2)
    reach = 64 + int(12 * math.sqrt(sample / n * good / n * bad * (n - sample) / max(1, n - 1)))
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (sample - k)) - np.log((k + 1) * (bad - sample + k + 1))
    size = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(size - size.max()))
    return low + min(high - low, int(np.searchsorted(total, rng.random() * total[-1], "right")))


def draw(quotas: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate-hypergeometric draw, one source after the other."""
    out, rest = np.zeros_like(quotas), int(quotas.sum())
    for k, q in enumerate(quotas.tolist()):
        rest -= q
        if take and q:
            out[k] = hypergeometric(q, rest, take, rng)
        take -= int(out[k])
    return out


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Plan:
    """sources: a row per source with its size, target, whole passes, blocks and the rules by which
    whole blocks belong to the partial pass; partly: keys taken from cut blocks; spans: a row per
    source with its drawn blocks' ranges by shard."""

    sources: DataFrame
    partly: DataFrame
    spans: DataFrame
    shards: int


def permuted(docs: DataFrame) -> DataFrame:
    """Adds __size, __source (never null) and __key, a hash that stands for the place in the permutation."""
    source = F.struct(F.col("source").isNull().alias("missing"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    return docs.select("*", n_words().alias("__size"), source.alias("__source")).withColumn(KEY, F.xxhash64(F.lit(SEED), F.col("doc_id"), "__size", "__source"))


def block_of(blocks: str = "__blocks") -> Column:
    """Block of a key: its upper 32 bits, scaled to the number of blocks."""
    upper = F.shiftrightunsigned(F.col(KEY), 32)
    return F.floor(upper * F.col(blocks) / F.lit(float(1 << 32))).cast("long")


def ends(sums: DataFrame, rooms: DataFrame) -> dict[int, tuple[int, int]]:
    """The block in which each source's room (__id, __room) ends and the words before it: the last block
    with words before it within the room. sums: (__id, __block, s).

    WIDE blocks are summed first, so no task gets more than a WIDE-th of a source's blocks.
    """

    def last(rows: DataFrame, by: str, open_: str) -> list:
        before = F.sum("s").over(Window.partitionBy("__id").orderBy(by)) - F.col("s")
        fit = rows.withColumn("__before", before).where(F.col("__before") <= F.col(open_))
        return fit.groupBy("__id").agg(F.max(by).alias("b"), F.max("__before").alias("w")).collect()  # a row for each source

    wide = sums.groupBy("__id", F.floor(F.col("__block") / WIDE).alias("__wide")).agg(F.sum("s").alias("s"))
    first = last(wide.join(F.broadcast(rooms), "__id"), "__wide", "__room")
    inside = sums.sparkSession.createDataFrame([(r["__id"], r.b, r.w) for r in first], "__id long, __wide long, __skipped long")
    rows = sums.withColumn("__wide", F.floor(F.col("__block") / WIDE)).join(F.broadcast(inside), ["__id", "__wide"]).join(F.broadcast(rooms), "__id")
    skipped = {r["__id"]: r.w for r in first}
    found = last(rows.withColumn("__left", F.col("__room") - F.col("__skipped")), "__block", "__left")
    return {r["__id"]: (r.b, r.w + skipped[r["__id"]]) for r in found}


def largest_first(listed: str = "rows", room: str = "__room") -> Column:
    """The keys and words of what fits into the room when the largest of the rows (s, key) are tried first."""
    start = F.struct(F.col(room).cast("double").alias("room"), F.array().cast("array<bigint>").alias("keys"))

    def add(a: Column, r: Column) -> Column:
        taken = F.struct((a["room"] - r["s"]).alias("room"), F.concat(a["keys"], F.array(r[KEY])).alias("keys"))
        return F.when((r["s"] > 0) & (r["s"] <= a["room"]), taken).otherwise(a)

    return F.aggregate(F.sort_array(listed, asc=False), start, add)


def plan(docs: DataFrame, shards: int | None = None) -> Plan:
    """Quotas and cuts. docs: with the columns of permuted(); only the slim ones are read here."""
    spark = docs.sparkSession
    slim = checkpoint(docs.groupBy("__source", KEY, "__size").agg(F.count("*").alias("__n")))
    found = slim.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("size"), F.sum("__n").alias("n")).orderBy("__source").limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    aims = targets([r["size"] for r in found])
    passes = [int(a // r["size"]) if r["size"] else 0 for a, r in zip(aims, found, strict=True)]
    room = {k: a - p * r["size"] for k, (a, p, r) in enumerate(zip(aims, passes, found, strict=True))}
    blocks = [max(1, -(-r["n"] // BLOCK)) for r in found]
    base = spark.createDataFrame([(r["__source"], k, blocks[k]) for k, r in enumerate(found)], "__source struct<missing: boolean, name: string>, __id long, __blocks long")
    rows = slim.join(F.broadcast(base), "__source").select("__id", KEY, "__size", block_of().alias("__block"), (F.col("__size") * F.col("__n")).alias("s"))
    # rules (from, to, most): of the blocks from up to to, documents of at most so many words are in the partial pass
    rules: dict[int, list[tuple[int, int, int]]] = {k: [] for k in room}
    start, most, last = dict.fromkeys(room, 0), {k: r["size"] for k, r in enumerate(found)}, dict.fromkeys(room, 0)
    parts: list[DataFrame] = []
    open_ = [k for k in room if room[k] > 0]
    while open_:
        state = spark.createDataFrame([(k, float(room[k]), start[k], int(most[k])) for k in open_], "__id long, __room double, __start long, __most long")
        able = rows.join(F.broadcast(state), "__id").where("__block >= __start and __size <= __most")
        cut = ends(able.groupBy("__id", "__block").agg(F.sum("s").alias("s")), state.select("__id", "__room"))
        for k, (b, w) in cut.items():
            rules[k].append((start[k], b, int(most[k])))
            room[k] -= w
            start[k], last[k] = b + 1, b
        at = spark.createDataFrame([(k, b, float(room[k])) for k, (b, _) in cut.items()], "__id long, __cut long, __room double")
        inside = able.drop("__room").join(F.broadcast(at), "__id").where("__block = __cut")
        picked = inside.groupBy("__id", "__room").agg(F.collect_list(F.struct("s", KEY)).alias("rows"))  # about BLOCK rows a source
        picked = checkpoint(picked.select("__id", largest_first().alias("f")).select("__id", "f.room", "f.keys"))
        parts.append(picked.select("__id", F.explode("keys").alias(KEY)))
        for r in picked.select("__id", "room").collect():
            room[r["__id"]] = r.room
        most |= {k: math.floor(room[k]) for k in cut}
        open_ = [k for k in cut if room[k] > CLOSE * aims[k] and start[k] < blocks[k]]
    partly = spark.createDataFrame([], f"__id long, {KEY} long")
    for x in parts:
        partly = partly.unionByName(x)
    quotas = np.array([passes[k] * blocks[k] + (last[k] + 1 if rules[k] else 0) for k in room], dtype=np.int64)
    if shards is None:
        shards = max(LEAST_SHARDS, math.ceil(sum(aims) / SHARD_WORDS))
    shards = max(1, min(shards, CELLS // max(1, len(found))))
    cells: list[tuple[int, list[tuple[int, list[tuple[int, int]]]]]] = []
    if len(found):
        edges = np.cumsum(split(quotas, shards, np.random.default_rng(SEED)), axis=0)
        for k in range(len(found)):
            own = [(int(e), j) for j, e in enumerate(edges[:, k].tolist()) if e > (edges[j - 1, k] if j else 0)]
            cells.append((k, [(part[-1][0], part) for part in (own[i : i + RANGES] for i in range(0, len(own), RANGES))]))
    spans = spark.createDataFrame(cells, "__id long, __spans array<struct<to: bigint, part: array<struct<to: bigint, shard: int>>>>")
    kind = "__source struct<missing: boolean, name: string>, __id long, source_size long, target double, __passes long, __blocks long, __rules array<struct<from: bigint, to: bigint, most: bigint>>"
    sources = spark.createDataFrame([(r["__source"], k, r["size"], aims[k], passes[k], blocks[k], rules[k]) for k, r in enumerate(found)], kind)
    return Plan(sources, checkpoint(partly.withColumn("__part", F.lit(1))), spans, shards)


def taken(docs: DataFrame, found: Plan) -> DataFrame:
    """Adds source_size, target and __copies to rows of permuted(); nothing but small tables moves.

    The sources table has a row for each of at most MAX_SOURCES sources.
    """
    out = docs.join(F.broadcast(found.sources), "__source", "left").withColumn("__block", block_of())
    picked = found.partly.hint("broadcast") if found.partly.count() <= MAX_KEYS else found.partly
    out = out.join(picked, ["__id", KEY], "left")
    whole = F.exists("__rules", lambda x: (F.col("__block") >= x["from"]) & (F.col("__block") < x["to"]) & (F.col("__size") <= x["most"]))
    part = F.when(F.col("__part").isNotNull() | F.coalesce(whole, F.lit(False)), 1).otherwise(0)
    return out.withColumn("__copies", (F.coalesce("__passes", F.lit(0)) + part).cast("long"))


def mix(docs: DataFrame, shards: int | None = None, found: Plan | None = None) -> DataFrame:
    """The mixed documents: a row for each copy, dealt to shards by the tree and shuffled inside each.

    Adds the column shard, or __shard where docs has one of that name. found: the plan, if it was made.
    """
    rows = permuted(docs)
    found = found or plan(rows, shards)
    name = "__shard" if "shard" in docs.columns else "shard"
    rows = taken(rows, found).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    # the place of a copy among its source's drawn blocks: whole passes first, then the partial pass
    place = F.col("__copy") * F.col("__blocks") + F.col("__block")
    rows = rows.withColumn("__place", place).join(F.broadcast(found.spans), "__id")  # CELLS ranges at most
    part = F.element_at(F.filter("__spans", lambda x: x["to"] > F.col("__place")), 1)["part"]
    shard = F.element_at(F.filter(part, lambda x: x["to"] > F.col("__place")), 1)["shard"]
    rows = rows.withColumn(name, shard)
    order = F.xxhash64(F.lit(SEED), F.col(KEY), "__copy")
    return rows.repartitionById(found.shards, F.col(name)).sortWithinPartitions(name, order).select(*docs.columns, name)


def dealt(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, size, source_size and target of every row, the words taken and the shards they lie in.

    docs: doc_id, text, source. Whole texts are dealt by mix(); copies are counted, and words counted
    anew, in what the shards hold. Equal rows share one fate, so each has its part of their copies.
    """
    rows = permuted(docs).drop("text")
    found = plan(rows, shards)
    # the number is drawn after the local shuffle, which Spark would leave out below an aggregate
    held = permuted(mix(docs, shards, found).withColumn("__at", F.monotonically_increasing_id()))
    same = ["doc_id", "__size", "__source"]
    counts = held.groupBy(*same).agg(F.count("__at").alias("__held"), F.sort_array(F.collect_set("shard")).alias("shards"))
    each = rows.groupBy(*same).agg(F.count("*").alias("__rows"))
    a, b = each.alias("a"), counts.alias("b")
    equal = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__size") == F.col("b.__size")) & (F.col("a.__source") == F.col("b.__source"))
    out = a.join(b, equal, "left").select("a.*", F.coalesce("__held", F.lit(0)).alias("__held"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    out = out.join(F.broadcast(found.sources), "__source", "left").withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows"))))
    return out.selectExpr("doc_id", "__size as size", "source_size", "target", "__held div __rows * __size as taken", "shards")
