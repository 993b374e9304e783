import random

import pytest

from cladeframe.operators import tree as T
from cladeframe.plans import catalogue, oracles
from cladeframe.sources import newick, tree_yaml
from cladeframe.sources import yaml_io as Y

TEXT = "(((A:0.1,B:0.2)0.7:0.5,(E:0.1,F:0.2)0.95:0.3)0.98:0.1,(C:0.3,'D d':0.4)0.99:0.5);"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], T.NODES)


def test_newick_round_trip():
    rows = newick.parse(TEXT)
    assert [r["name"] for r in rows if r["kind"] == "LEAF"] == ["A", "B", "E", "F", "C", "D d"]
    assert [r["support"] for r in rows if r["kind"] == "NODE"] == [0.98, 0.7, 0.95, 0.99]
    assert newick.parse(newick.render(rows)) == rows
    assert newick.parse("(,b);")[1]["name"] == "Unnamed"
    with pytest.warns(UserWarning):
        newick.parse("(a,b,c);")
    with pytest.raises(ValueError):
        newick.parse("(a,b,c);", require_rooted=True)
    with pytest.raises(ValueError):
        newick.parse("((a,b);")


def test_collapse_lifts_children(spark):
    rows = newick.parse(TEXT)
    out = {r.node_id: r.parent_id for r in T.collapse(frame(spark, rows), 0.96).collect()}
    by_name = {r["name"]: r["node_id"] for r in rows if r["name"]}
    upper = next(r["node_id"] for r in rows if r["support"] == 0.98)
    assert all(out[by_name[x]] == upper for x in "ABEF")
    assert sorted(r["support"] for r in rows if r["node_id"] in out and r["support"]) == [0.98, 0.99]


def test_closure_and_paths_of_random_trees(spark):
    rng = random.Random(4)
    rows = [{"node_id": 0, "parent_id": None, "kind": "ROOT", "name": None, "support": None, "length": 0.0, "child_ord": 0}]
    for i in range(1, 60):
        up = rng.choice([r for r in rows if r["kind"] != "LEAF"])["node_id"]
        rows.append({"node_id": i, "parent_id": up, "kind": rng.choice(["NODE", "LEAF"]), "name": f"n{i}", "support": None, "length": 1.0, "child_ord": i})
    parent = {r["node_id"]: r["parent_id"] for r in rows}

    def above(n):
        out = []
        while parent[n] is not None:
            out.append(n := parent[n])
        return out

    got = {(r.node_id, r.anc_id, r.dist) for r in T.closure(frame(spark, rows)).collect()}
    assert got == {(n, a, k + 1) for n in parent for k, a in enumerate(above(n))}
    for r in T.leaf_paths(frame(spark, rows)).collect():
        assert r.path == [*reversed(above(r.node_id)), r.node_id]


def test_nested_yaml_and_pretty():
    rows = newick.parse(TEXT)
    back = T.flattened(Y.load(Y.tree_text(rows)))
    assert [(r["node_id"], r["parent_id"], r["name"]) for r in back] == [(r["node_id"], r["parent_id"], r["name"]) for r in rows]
    assert T.pretty(T.nested(rows)).splitlines()[0].startswith("ROOT 0")


def test_midpoint_root_balances_the_longest_path():
    rows = T.midpoint_rooted(newick.parse("((a:1,b:1)0.9:1,c:9);"))
    parent = {r["node_id"]: (r["parent_id"], r["length"]) for r in rows}

    def depth(n):
        total = 0.0
        while parent[n][0] is not None:
            total += parent[n][1]
            n = parent[n][0]
        return total

    far = sorted((depth(r["node_id"]) for r in rows if r["kind"] == "LEAF"), reverse=True)
    assert far[0] == pytest.approx(far[1]) == pytest.approx(5.5)
    assert sorted(r["name"] for r in rows if r["kind"] == "LEAF") == ["a", "b", "c"]


@pytest.fixture
def tiny_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(held, ("70", "0"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


ODD = [None, "", "a b", " - id: 7", "- id: 7", "id: 7", "a\n- id: 3\n", "x\r\ny", "'", '"', "null", "12", "1.0", "~", "#", "a: b", "ß\u2028\x85", "\ufeff", "\x07", "😀", "---", "y" * 300, "w " * 100]


def test_tree_parts_round_trip_wherever_files_are_cut(spark, tmp_path, tiny_splits):
    rng = random.Random(6)
    rows = [{"node_id": 0, "parent_id": None, "kind": "ROOT", "name": None, "support": None, "length": 0.0, "child_ord": 0}]
    for i in range(1, 150):
        # half of the time on below the last inner node, so paths get long
        ups = [r for r in rows if r["kind"] != "LEAF"]
        up = rng.choice([ups[-1], rng.choice(ups)])["node_id"]
        n = sum(r["parent_id"] == up for r in rows)
        rows.append({"node_id": i, "parent_id": up, "kind": rng.choice(["NODE", "LEAF"]), "name": ODD[i % len(ODD)], "support": rng.choice([None, 99.0, 1e22, 1e-7, float("inf")]), "length": rng.random(), "child_ord": n})
    nodes = frame(spark, rng.sample(rows, len(rows)))
    tree_yaml.write(nodes.repartition(7), at := str(tmp_path / "tree"))
    assert [r.asDict() for r in tree_yaml.read(spark, at).orderBy("node_id").collect()] == rows
    text = "".join(p.read_text() for p in sorted((tmp_path / "tree").glob("part-*")))
    assert Y.load(text) == T.nested(rows)
    assert spark.read.text(at).rdd.getNumPartitions() > 100


def test_tree_parts_keep_roots_orphans_and_copies(spark, tmp_path):
    rows = [(0, None, "ROOT"), (1, 0, "NODE"), (1, 0, "NODE"), (2, 1, "LEAF"), (2, 1, "LEAF"), (3, 77, "LEAF"), (4, None, "LEAF"), (None, 1, "LEAF"), (5, 78, "NODE"), (6, 5, "NODE"), (7, 6, "LEAF")]
    tree_yaml.write(frame(spark, [dict(zip("ipknslo", (*r, None, None, None, None), strict=True)) for r in rows]), at := str(tmp_path / "tree"))
    got = tree_yaml.read(spark, at).select("node_id", "parent_id", "kind").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    (tmp_path / "bad").write_text("root:\n  id: 0\n  kind: ROOT\n")
    with pytest.raises(ValueError, match="before the first node"):
        tree_yaml.read(spark, str(tmp_path / "bad"))


def test_yaml_round_trip_query_leaves_nodes_to_the_executors(spark, tmp_path, monkeypatch):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    kind = pa.schema([("c_custkey", pa.int64()), ("c_name", pa.string()), ("c_nationkey", pa.int32()), ("c_acctbal", pa.float64())])
    customers = [{"c_custkey": i, "c_name": None if i == 5 else f"Customer#{i}", "c_nationkey": None if i == 3 else 40 if i == 4 else i % 3, "c_acctbal": i / 7} for i in range(3000)]
    pq.write_table(pa.Table.from_pylist(customers, kind), tmp_path / "customer.parquet")
    for t in ("region", "nation"):
        (tmp_path / f"{t}.parquet").write_bytes(open(f"/root/testdata/sf0.001/{t}.parquet", "rb").read())
    kind = type(spark.range(1))
    seen, collect = [], kind.collect
    with monkeypatch.context() as m:
        m.setattr(kind, "collect", lambda df: seen.append(len(rows := collect(df))) or rows)
        got = catalogue.tree_yaml_roundtrip(spark, str(tmp_path))
    assert max(seen, default=0) < 100
    db = duckdb.connect()
    for t in ("region", "nation", "customer"):
        db.sql(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, db.sql(oracles.oracle_sql()["tree_yaml_roundtrip"]).fetchall()))
