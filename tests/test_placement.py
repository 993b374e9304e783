"""The set form of placement against the literal walk, on random trees and k-mers."""

import random

import pytest
from pyspark.sql import functions as F

from cladeframe.functions import seq as S
from cladeframe.functions import status as X
from cladeframe.operators import index as I
from cladeframe.operators import place as P
from cladeframe.operators import tree as T

K = 5


def both(seq):
    other = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return {s[i : i + K] for s in (seq, other) for i in range(len(s) - K + 1)}


def walk(query, kmers, children, kind):
    """Descends from the root as long as a child holds more of the query's k-mers than its siblings together."""
    mine = {n: kmers.get(n, set()) & both(query) for n in kind}
    if len(query) < K:
        return X.ERROR, None, None, None
    if not mine[0]:
        return X.UNCLASSIFIABLE, None, None, None
    at, first = 0, True
    while True:
        inner = [c for c in children.get(at, []) if kind[c] != "LEAF" and mine[c]]
        won = []
        for c in inner:
            rest = set().union(*[mine[o] for o in inner if o != c])
            if len(mine[c]) > len(rest):
                won.append((c, len(mine[c]), len(rest)))
        if not won:
            return (X.UNCLASSIFIABLE, None, None, None) if first else (X.RESOLUTION, at, None, None)
        assert len(won) == 1
        at, one, rest = won[0]
        first = False
        if not any(kind[c] != "LEAF" for c in children.get(at, [])):
            return X.IDENTITY, at, one, rest


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(0, None, "ROOT", None)]
    for i in range(1, 14):
        rows.append((i, rng.choice([r[0] for r in rows]), "NODE", None))
    leaves = [(100 + i, rng.choice([r[0] for r in rows]), "LEAF", f"s{i}") for i in range(25)]
    parts = ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(10)]
    seqs = {f"s{i}": "".join(rng.sample(parts, 2)) for i in range(25)}
    everything = rows + leaves
    kind, parent = {r[0]: r[2] for r in everything}, {r[0]: r[1] for r in everything}
    children, kmers = {}, {}
    for n, p in parent.items():
        children.setdefault(p, []).append(n)
    for n, _, _, name in leaves:
        at = n
        while at is not None:
            kmers.setdefault(at, set()).update(both(seqs[name]))
            at = parent[at]
    queries = {f"q{i}": "".join(rng.choice([*parts, "ACGTTTGCA"]) for _ in range(rng.randint(1, 3)))[: rng.randint(3, 30)] for i in range(25)}
    queries["none"] = "A" * 4 + "C" * 4 + "A" * 9
    nodes = spark.createDataFrame([(n, p, k, name, None, 1.0, 0) for n, p, k, name in everything], T.NODES)
    records = spark.createDataFrame([(k, h, s) for k, (h, s) in enumerate(seqs.items())], "rec_no long, header string, seq string")
    index = I.build(records, nodes, K, 2)
    inner, _ = T.inner_nodes(nodes)
    frame = spark.createDataFrame(list(queries.items()), "query string, seq string")
    got = {r.query: (r.status, r.clade_id, r.one, r.rest) for r in P.place(frame, index, inner, K).collect()}
    assert got == {q: walk(s, kmers, children, kind) for q, s in queries.items()}
    # the intersection changes counts only, and the other strand changes nothing
    other = P.place(frame, index, inner, K, remove_intersection=True)
    assert {r.query: (r.status, r.clade_id) for r in other.collect()} == {q: v[:2] for q, v in got.items()}
    turned = frame.withColumn("seq", F.reverse(F.translate("seq", "ACGT", "TGCA")))
    assert {r.query: (r.status, r.clade_id, r.one, r.rest) for r in P.place(turned, index, inner, K).collect()} == got


def test_limits_and_errors(spark):
    nodes = spark.createDataFrame([(0, None, "ROOT", None, None, 0.0, 0), (1, 0, "NODE", None, None, 1.0, 0), (2, 1, "LEAF", "a", None, 1.0, 0)], T.NODES)
    records = spark.createDataFrame([(0, "a", "ACGTACGTTGCA")], "rec_no long, header string, seq string")
    index = I.build(records, nodes, K, 2)
    inner, _ = T.inner_nodes(nodes)
    frame = spark.createDataFrame([("a", "ACGTACGTTGCA"), ("short", "ACG"), ("empty", ""), ("null", None)], "query string, seq string")
    got = {r.query: (r.status, r.message, r.clade_id) for r in P.place(frame, index, inner, K).collect()}
    assert got["a"] == (X.IDENTITY, None, 1)
    assert got["short"] == got["empty"] == got["null"] == (X.ERROR, X.TOO_SHORT, None)
    none = P.place(frame, index, inner, K, max_iterations=0).where("query = 'a'").first()
    assert (none.status, none.message) == (X.ERROR, X.TOO_MANY)
    with pytest.raises(Exception, match="no leaf has the name b"):
        I.build(records.withColumn("header", F.lit("b")), nodes, K, 2).count()
    moved = records.unionByName(spark.createDataFrame([(1, "a", "TTTTTTTTTT")], records.schema))
    assert {r.t for r in I.build(moved, nodes, K, 2, "shifted").select(S.unpacked(F.col("kmer"), K).alias("t")).collect()} == both("ACGTACGTTGCA")


def test_root_index_matches_as_the_whole_index_does(spark):
    rng = random.Random(8)
    nodes = spark.createDataFrame([(0, None, T.ROOT, None), (1, 0, T.NODE, None), *((i, i % 2, T.LEAF, f"s{i}") for i in range(2, 8))], "node_id long, parent_id long, kind string, name string")
    nodes = nodes.selectExpr("*", "null support", "1d length", "0 child_ord")
    records = spark.createDataFrame([(f"s{i}", "".join(rng.choices("ACGT", k=30 * (i % 3)))) for i in range(2, 8)], "header string, seq string")
    asked = spark.createDataFrame([(f"q{i}", "".join(rng.choices("ACGT", k=40))) for i in range(9)] + [("none", "")], "query string, seq string")
    whole, root = (sorted(P.matched(P.tallies(P.hits(asked, x, K))).collect()) for x in (I.build(records, nodes, K), I.build_root(records, nodes, K)))
    assert whole == root and len(root) == 9
    with pytest.raises(Exception, match="no leaf has the name"):
        I.build_root(records, nodes.where("node_id < 5"), K).collect()
