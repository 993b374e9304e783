import random
from decimal import Decimal

from pyspark.sql import functions as F

from cladeframe.functions import murmur
from cladeframe.functions import seq as S
from cladeframe.functions import status as X
from cladeframe.plans import catalogue


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column(F.col("s")).alias("r")).first().r


def test_sanitize_and_strands(spark):
    assert one(spark, "acgtNNRY-aéc", S.sanitize) == "ACGTAC"
    assert one(spark, "AACGT", S.reverse_complement) == "ACGTT"
    assert one(spark, "AACG", lambda c: S.kmers(c, 3)) == ["AAC", "ACG"]
    assert one(spark, "AA", lambda c: S.kmers(c, 3)) == []
    assert one(spark, "AACG", lambda c: S.kmers_both(c, 3)) == ["AAC", "ACG", "CGT", "GTT"]
    assert one(spark, "ACGT", lambda c: S.minimizer(c, 0)) == ""


def test_exploded_kmers_of_long_sequences(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("ACGT") for _ in range(3 * S.CHUNK + 7))
    df = spark.createDataFrame([(text,)], "seq string")
    other = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for k in (1, 9, 31, 32, 35, 62, 70):
        packed = S.explode_kmers(df, k)
        rows = packed.select(S.unpacked(packed.kmer, k).alias("t"), S.bucket(packed.kmer, k, 1).alias("b"), "kmer").collect()
        assert sorted(r.t for r in rows) == sorted(s[i : i + k] for s in (text, other) for i in range(len(s) - k + 1)), k
        assert {(r.t[0], r.b) for r in rows} == ({(c, n) for n, c in enumerate("ACGT")} if k <= 62 else {(c, c) for c in "ACGT"})
        assert [r.t for r in sorted(rows, key=lambda r: r.kmer)] == sorted(r.t for r in rows)
    assert S.explode_kmers(df, 9, both=False).count() == len(text) - 8


def test_vectorised_hashes_equal_plain_ones(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("ACGT") for _ in range(900))
    for k in (4, 12, 16, 31, 35, 48):
        got = murmur.window_hashes(text, k).tolist()
        assert got == [murmur.hash64(text[i : i + k]) for i in range(len(text) - k + 1)]
    words = ["", "hello", "ACGT" * 9, None, "hello"]
    found = spark.createDataFrame([(w,) for w in words], "w string").select(murmur.hash_column(F.col("w")).alias("h")).collect()
    assert [None if r.h is None else r.h % 2**64 for r in found] == [None if w is None else murmur.hash64(w) for w in words]


def test_murmur_known_values():
    assert murmur.hash64("") == 0
    assert murmur.hash64("hello") == 0xCBD8A7B341BD9B02  # a published test vector
    assert len({murmur.hash64("ACGT" * k) for k in range(1, 40)}) == 39


def test_expected_coverage_rounds_half_up(spark):
    rows = spark.createDataFrame([(1,), (5,)], "m long").select(X.expected_coverage(F.col("m"), 0.5).alias("e")).collect()
    assert [r.e for r in rows] == [1, 3]
    assert X.clamp(7) == 1.0 and X.clamp(-1) == 0.0


def test_root_coverage_takes_halves_exactly(spark, monkeypatch):
    counts = [*range(1, 4000), 10**9 + 5, 10**12 + 5]
    tally = spark.createDataFrame([(f"q{m}", None, m) for m in counts], "query string, node_id long, one long")
    monkeypatch.setattr(catalogue.P, "matched", lambda _: tally.select("query", F.col("one").alias("matched")))
    got = {r.matched: (r.expected, r.enough) for r in catalogue.root_coverage(spark, "/root/testdata/sf0.001").collect()}
    assert got == {m: ((7 * m + 5) // 10, True) for m in counts} and got[45] == (32, True)
    # of doubles, where 45 * 0.7 is under 31.5, as in the reference
    rows = spark.range(45, 46).select(*[X.expected_coverage(F.col("id"), c).alias(n) for n, c in (("near", 0.7), ("exact", Decimal("0.7")), ("above", Decimal("1.7")))]).first()
    assert tuple(rows) == (31, 32, 45)
