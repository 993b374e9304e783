"""Scalar functions on sequences, as column expressions inside the JVM.

A k-mer of an index or a query is packed: two bits a base (A, C, G, T in order), up to WORD bases in
a long, up to twice as many in a struct of two longs; a longer one is a string. The order of packed
k-mers is that of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows of one sequence that are handled as one array; short, as finding a place in a string walks from its start.
CHUNK = 512
#: Bases that a long holds beside its sign, and bases of a block that is packed at once.
WORD, BLOCK = 31, 32
#: The complement of each base.
BASES, COMPLEMENTS = "ACGT", "TGCA"


def sanitize(seq: Column) -> Column:
    """Upper case, and only A, C, G and T kept."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def kmers(seq: Column, k: int) -> Column:
    """All windows of k bases in order; none if the sequence is shorter."""
    size = F.length(seq)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(size >= k, windows).otherwise(F.array().cast("array<string>"))


def kmers_both(seq: Column, k: int) -> Column:
    """Windows of the sequence, then of its reverse complement; repeats kept."""
    return F.concat(kmers(seq, k), kmers(reverse_complement(seq), k))


def minimizer(kmer: Column, m: int) -> Column:
    """The first m bases of a k-mer given as text: the bucket it lives in; one bucket for m = 0."""
    return F.substring(kmer, 1, m) if m > 0 else F.lit("")


def bucket(kmer: Column, k: int, m: int) -> Column:
    """The minimizer of a packed k-mer: a number for up to WORD bases, else text."""
    if k > 2 * WORD:
        return minimizer(kmer, m)
    first, size = (kmer, k) if k <= WORD else (kmer["a"], WORD)
    return F.shiftright(first, 2 * (size - m)) if m <= size else unpacked(kmer, k)


def word_text(word: Column, size: int) -> Column:
    return F.translate(F.lpad(F.conv(word.cast("string"), 10, 4), size, "0"), "0123", BASES) if size > 0 else F.lit("")


def unpacked(kmer: Column, k: int) -> Column:
    """The text of a packed k-mer."""
    if k > 2 * WORD:
        return kmer
    return word_text(kmer, k) if k <= WORD else F.concat(word_text(kmer["a"], WORD), word_text(kmer["b"], k - WORD))


def bucket_text(minimizer: Column, k: int, m: int) -> Column:
    """The text of what bucket() gives."""
    return minimizer if k > 2 * WORD or m > min(k, WORD) else word_text(minimizer, m)


def blocks(seq: Column) -> Column:
    """A sequence as longs of BLOCK bases each, filled up with the first base."""
    count = F.floor((F.length(seq) + BLOCK - 1) / BLOCK).cast("int")

    def block(j: Column) -> Column:
        part = F.rpad(F.translate(F.substring(seq, j * BLOCK + 1, F.lit(BLOCK)), BASES, "0123"), BLOCK, "0")
        return F.conv(part, 4, -10).cast("long")

    return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), block)


def packed_kmers(blocks: Column, size: Column, k: int) -> Column:
    """All windows of k bases, packed, of a sequence of so many bases given as blocks."""

    def window(at: Column, bases: int) -> Column:
        j, skip = F.shiftright(at, 5), at.bitwiseAND(F.lit(BLOCK - 1)) * 2
        here = F.call_function("shiftleft", F.get(blocks, j), skip)
        # a shift by 64 is one by 0, so the next block is moved in two steps
        rest = F.shiftrightunsigned(F.call_function("shiftrightunsigned", F.coalesce(F.get(blocks, j + 1), F.lit(0).cast("long")), F.lit(63) - skip), 1)
        return F.shiftrightunsigned(here.bitwiseOR(rest), 2 * (BLOCK - bases))

    def kmer(i: Column) -> Column:
        return window(i, k) if k <= WORD else F.struct(window(i, WORD).alias("a"), window(i + WORD, k - WORD).alias("b"))

    kind = "array<bigint>" if k <= WORD else "array<struct<a:bigint,b:bigint>>"
    return F.when(size >= k, F.transform(F.sequence(F.lit(0), F.greatest(size - k, F.lit(0))), kmer)).otherwise(F.array().cast(kind))


def to_fasta(header: Column, seq: Column) -> Column:
    return F.format_string(">%s\n%s\n", header, seq)


def chunks(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """A row for each stretch (__chunk) of a sequence; neighbours overlap, so each window of k bases is in one of them."""
    size = F.length(seq)
    starts = F.when(size >= k, F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1)), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("__start", F.explode(starts)).withColumn("__chunk", F.substring(F.col(seq), F.col("__start"), F.lit(CHUNK + k - 1))).drop("__start")


def explode_kmers(df: DataFrame, k: int, seq: str = "seq", name: str = "kmer", both: bool = True) -> DataFrame:
    """A row for each k-mer, packed. A sequence is first cut into overlapping chunks, so one of any length never becomes one array."""
    cut = chunks(df, k, seq)
    # the other strand and the blocks are columns of their own: inside the lambda they would be made again for each window
    cut = cut.withColumn("__other", reverse_complement(F.col("__chunk")) if both else F.lit(None).cast("string"))
    strands = ["__chunk", "__other"] if both else ["__chunk"]
    if k > 2 * WORD:
        windows = [kmers(F.col(x), k) for x in strands]
    else:
        cut = cut.withColumns({f"{x}_blocks": blocks(F.col(x)) for x in strands}).withColumn("__size", F.length("__chunk"))
        windows = [packed_kmers(F.col(f"{x}_blocks"), F.col("__size"), k) for x in strands]
    return cut.withColumn(name, F.explode(F.concat(*windows) if both else windows[0])).drop("__chunk", "__other", "__chunk_blocks", "__other_blocks", "__size", seq)
