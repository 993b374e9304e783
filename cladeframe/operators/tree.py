"""Trees as adjacency tables: nodes(node_id, parent_id, kind, name, support, length, child_ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint

ROOT, NODE, LEAF = "ROOT", "NODE", "LEAF"
NODES = "node_id long, parent_id long, kind string, name string, support double, length double, child_ord int"


def closure(nodes: DataFrame) -> DataFrame:
    """(node_id, anc_id, dist) of each node and its proper ancestors, by doubling: log2(depth) joins."""
    known = nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("anc_id"), F.lit(1).alias("dist"))
    known, reach = checkpoint(known), 1
    while True:
        edge = known.where(F.col("dist") == reach).select("node_id", F.col("anc_id").alias("via"))
        up = known.select(F.col("node_id").alias("via"), "anc_id", (F.col("dist") + reach).alias("dist"))
        more = checkpoint(edge.join(up, "via").select("node_id", "anc_id", "dist"))
        if more.isEmpty():
            return known
        known, reach = known.unionByName(more), reach * 2


def with_self(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.unionByName(nodes.select("node_id", F.col("node_id").alias("anc_id"), F.lit(0).alias("dist")))


def kept(min_support: float):
    """Whether a node stays when low support is collapsed: the root, leaves, unknown support, enough support."""
    return F.col("kind").isin(ROOT, LEAF) | F.col("support").isNull() | (F.col("support") >= min_support)


def collapse(nodes: DataFrame, min_support: float, inner_pairs: DataFrame | None = None) -> DataFrame:
    """Collapses nodes of low support: children go to the nearest kept ancestor, with their own length.

    Only inner nodes enter the closure; leaves look their parent up.
    """
    inner = nodes.where(F.col("kind") != LEAF)
    pairs = with_self(closure(inner) if inner_pairs is None else inner_pairs, inner)
    good = inner.where(kept(min_support)).select(F.col("node_id").alias("anc_id"))
    nearest = pairs.join(good, "anc_id").groupBy("node_id").agg(F.min_by("anc_id", "dist").alias("stands"))
    out = nodes.where(kept(min_support)).join(nearest.withColumnRenamed("node_id", "parent_id"), "parent_id", "left")
    return out.select("node_id", F.col("stands").alias("parent_id"), "kind", "name", "support", "length", "child_ord")


def inner_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inner nodes below the root (node_id, parent_id, depth, has_inner_child), and their closure
    (node_id, anc_id) with themselves and without the root."""
    inner = nodes.where(F.col("kind") != LEAF)
    pairs = with_self(closure(inner), inner)
    root = nodes.where("parent_id is null").select(F.col("node_id").alias("anc_id"))
    pairs = pairs.join(root, "anc_id", "left_anti").join(root.withColumnRenamed("anc_id", "node_id"), "node_id", "left_anti")
    depth = pairs.groupBy("node_id").agg(F.count("*").cast("int").alias("depth"))
    parents = inner.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct().withColumn("has_inner_child", F.lit(True))
    table = inner.select("node_id", "parent_id").join(depth, "node_id").join(parents, "node_id", "left")
    return table.select("node_id", "parent_id", "depth", F.coalesce("has_inner_child", F.lit(False)).alias("has_inner_child")), pairs.select("node_id", "anc_id")


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path) of each leaf: the ids from the root to the leaf."""
    inner = nodes.where(F.col("kind") != LEAF)
    above = with_self(closure(inner), inner)
    up = above.groupBy(F.col("node_id").alias("parent_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dist", "anc_id")), asc=False), lambda x: x["anc_id"]).alias("up"))
    leaves = nodes.where(F.col("kind") == LEAF).select("node_id", "parent_id")
    return leaves.join(up, "parent_id").select("node_id", F.concat("up", F.array("node_id")).alias("path"))


def path_to_root(nodes: DataFrame) -> DataFrame:
    """(node_id, anc_id) of every node with itself and all its ancestors."""
    return with_self(closure(nodes), nodes).select("node_id", "anc_id")


def preorder(nodes: DataFrame) -> DataFrame:
    """Adds depth, has_children and rank: by rank, a node stands before all below it, and siblings by child_ord and id.

    A node whose parent is no inner node of the table is a root.
    """
    step = F.struct(F.col("child_ord").isNull().alias("last"), "child_ord", "node_id")
    inner = checkpoint(nodes.where(F.col("kind") != LEAF).dropDuplicates(["node_id"]))
    steps = with_self(closure(inner), inner).join(inner.select(F.col("node_id").alias("anc_id"), step.alias("step")), "anc_id")
    up = steps.groupBy(F.col("node_id").alias("parent_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dist", "step")), asc=False), lambda x: x["step"]).alias("up"))
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct().withColumn("has_children", F.lit(True))
    rows = nodes.join(up, "parent_id", "left").join(parents, "node_id", "left").withColumn("rank", F.when(F.col("up").isNull(), F.array(step)).otherwise(F.concat("up", F.array(step))))
    return rows.select(*nodes.columns, (F.size("rank") - 1).alias("depth"), F.coalesce("has_children", F.lit(False)).alias("has_children"), "rank")


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def children(nodes: DataFrame) -> DataFrame:
    """Per node: all children and inner children."""
    rows = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id"))
    return rows.agg(F.count("*").alias("n_children"), F.count_if(F.col("kind") != LEAF).alias("n_inner"))


def nested(rows: list[dict]) -> dict:
    """The nested form of a tree's or a clade's rows, for export; fields without a value are left out."""
    by: dict[int | None, list[dict]] = {}
    ids = {r["node_id"] for r in rows}
    for r in sorted(rows, key=lambda r: (r["child_ord"] is None, r["child_ord"], r["node_id"])):
        by.setdefault(r["parent_id"] if r["parent_id"] in ids else None, []).append(r)
    made: dict[int, dict] = {}
    todo = list(by.get(None, []))
    order = []
    while todo:
        r = todo.pop()
        order.append(r)
        todo += by.get(r["node_id"], [])
    for r in order:
        made[r["node_id"]] = {k: v for k, v in (("id", r["node_id"]), ("parent", r["parent_id"]), ("kind", r["kind"]), ("name", r["name"]), ("support", r["support"]), ("length", r["length"])) if v is not None}
    for r in order:
        if below := by.get(r["node_id"]):
            made[r["node_id"]]["children"] = [made[c["node_id"]] for c in below]
    return made[by[None][0]["node_id"]]


def flattened(tree: dict) -> list[dict]:
    """The rows of a nested tree."""
    out, todo = [], [(tree, None, 0)]
    while todo:
        t, parent, k = todo.pop()
        out.append({"node_id": t["id"], "parent_id": parent, "kind": t["kind"], "name": t.get("name"), "support": t.get("support"), "length": t.get("length"), "child_ord": k})
        todo += [(c, t["id"], i) for i, c in enumerate(t.get("children") or [])]
    return sorted(out, key=lambda r: r["node_id"])


def pretty(tree: dict) -> str:
    """An indented text of a nested tree."""
    lines, todo = [], [(tree, 0)]
    while todo:
        t, level = todo.pop()
        extra = "".join(f" {k}={t[k]}" for k in ("name", "support", "length") if t.get(k) is not None)
        lines.append(f"{'  ' * level}{t['kind']} {t['id']}{extra}")
        todo += [(c, level + 1) for c in reversed(t.get("children") or [])]
    return "\n".join(lines)


def midpoint_rooted(rows: list[dict]) -> list[dict]:
    """Roots an edge list of a tree at the midpoint of its longest leaf-to-leaf path; labels stay with their edges."""
    graph: dict[int, dict[int, tuple[float, float | None]]] = {}
    info = {r["node_id"]: r for r in rows}
    for r in rows:
        graph.setdefault(r["node_id"], {})
        if r["parent_id"] is not None:
            edge = (r["length"] or 0.0, r["support"])
            graph[r["node_id"]][r["parent_id"]] = edge
            graph.setdefault(r["parent_id"], {})[r["node_id"]] = edge

    def far(start: int) -> tuple[int, dict[int, tuple[float, int | None]]]:
        seen: dict[int, tuple[float, int | None]] = {start: (0.0, None)}
        todo = [start]
        while todo:
            n = todo.pop()
            for m, (length, _) in graph[n].items():
                if m not in seen:
                    seen[m] = (seen[n][0] + length, n)
                    todo.append(m)
        return max((n for n in seen if info[n]["kind"] == LEAF), key=lambda n: seen[n][0]), seen

    a, _ = far(next(n for n in info if info[n]["kind"] == LEAF))
    b, seen = far(a)
    half, n = seen[b][0] / 2, b
    while seen[n][1] is not None and seen[seen[n][1]][0] > half:
        n = seen[n][1]
    up = seen[n][1] if seen[n][1] is not None else next(iter(graph[n]))
    length, support = graph[n].pop(up)
    graph[up].pop(n)
    below = seen[n][0] - half
    new = max(info) + 1
    graph[new] = {n: (below, support), up: (length - below, support)}
    out, todo, count = [], [(new, None, 0.0, None, 0)], 0
    ids: dict[int, int] = {}
    while todo:
        node, parent, dist, label, k = todo.pop()
        down = [(m, e) for m, e in graph[node].items() if m != parent]
        if parent is not None and node not in (new,) and info[node]["kind"] != LEAF and len(down) == 1:
            todo.append((down[0][0], parent, dist + down[0][1][0], down[0][1][1], k))  # the old root, now on an edge
            graph[down[0][0]][parent] = (0.0, None)
            graph[down[0][0]].pop(node, None)
            continue
        ids[node] = count
        leaf = node != new and info[node]["kind"] == LEAF
        out.append({"node_id": count, "parent_id": ids.get(parent), "kind": ROOT if parent is None else LEAF if leaf else NODE, "name": info[node]["name"] if leaf else None, "support": None if leaf or parent is None else label, "length": dist, "child_ord": k})
        count += 1
        todo += [(m, node, e[0], e[1], i) for i, (m, e) in reversed(list(enumerate(down)))]
    return out
