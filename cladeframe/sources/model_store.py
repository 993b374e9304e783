"""Models: a Parquet folder as the native form, and an exchange form as (compressed) YAML or JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import murmur
from ..functions import seq as S
from ..operators import index as I
from ..operators import tree as T
from . import yaml_io as Y

MODEL = "id string, name string, min_branch_support double, k int, m int, hashed boolean"


@dataclass
class Model:
    id: str
    name: str
    min_branch_support: float
    k: int
    m: int
    nodes: DataFrame
    index: DataFrame
    annotations: DataFrame | None = None
    #: whether k-mers and minimizers are the hashes of an exchanged model instead of packed bases
    hashed: bool = False


def save(model: Model, path: str, mode: str = "errorifexists") -> None:
    """Writes path/{model,nodes,kmers,annotations}; k-mers are sorted by bucket and k-mer inside each
    file, so row groups hold a narrow range of both and a lookup reads few of them."""
    spark = model.nodes.sparkSession
    spark.createDataFrame([(model.id, model.name, float(model.min_branch_support), model.k, model.m, model.hashed)], MODEL).write.mode(mode).parquet(f"{path}/model")
    model.nodes.write.mode(mode).parquet(f"{path}/nodes")
    model.index.repartitionByRange("minimizer", "kmer").sortWithinPartitions("minimizer", "kmer").write.mode(mode).option("compression", "zstd").parquet(f"{path}/kmers")
    if model.annotations is not None:
        model.annotations.write.mode(mode).parquet(f"{path}/annotations")


def load(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(f"{path}/model").first()
    try:
        notes = spark.read.parquet(f"{path}/annotations")
        notes.schema  # noqa: B018  fails here if there are none
    except Exception:  # noqa: BLE001  any reader's way to say that the folder is missing
        notes = None
    return Model(r.id, r.name, r.min_branch_support, r.k, r.m, spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/kmers"), notes, bool(r.hashed))


def real_bytes(model: Model) -> DataFrame:
    """Bytes of the index's k-mers and clade numbers, as one row."""
    return model.index.agg(F.sum(8 * -(-model.k // S.WORD) + 8 * F.size("clades")).alias("index_bytes"))


def exported(model: Model, only_tree: bool = False) -> dict:
    """The nested exchange form, gathered on the driver: keys of k-mers and buckets are 64-bit hashes."""
    root = T.nested([r.asDict() for r in model.nodes.collect()])
    if only_tree:
        return root
    out: dict = {"id": model.id, "name": model.name, "minBranchSupport": model.min_branch_support, "inMemorySize": "0.000000 Mb", "root": root}
    if model.annotations is not None:
        out["annotations"] = [{"clade": r.clade, "meta": Y.tagged(r.meta)} for r in model.annotations.orderBy("clade").collect()]
    buckets: dict[int, dict[int, list[int]]] = {}
    if model.hashed:
        bucket, kmer = F.col("minimizer"), F.col("kmer")
    else:
        text = S.unpacked(F.col("kmer"), model.k)
        bucket, kmer = murmur.hash_column(S.minimizer(text, model.m)) if model.m else F.lit(0).cast("long"), murmur.hash_column(text)
    for r in model.index.select(bucket.alias("b"), kmer.alias("h"), F.transform("clades", lambda c: c["node_id"]).alias("n")).toLocalIterator():
        buckets.setdefault(r.b % (1 << 64), {})[r.h % (1 << 64)] = [root["id"], *r.n]
    out["kmersMap"] = {"kSize": model.k, "mSize": model.m, "map": buckets}
    return out


def export(model: Model, path: str, form: str = "zstd", only_tree: bool = False) -> None:
    """Writes the exchange form: zstd (YAML, compressed), yaml or json."""
    found = exported(model, only_tree)
    if form == "json":
        Path(path).write_text(json.dumps(found, indent=2))
    elif form == "yaml":
        Path(path).write_text(Y.dump(found))
    else:
        import zstandard

        Path(path).with_suffix(".cls").write_bytes(zstandard.ZstdCompressor().compress(Y.dump(found).encode()))


def read_exchange(path: str) -> dict:
    """An exchange file: compressed YAML, plain YAML or JSON, tried in this order."""
    data = Path(path).read_bytes()
    try:
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except Exception as zstd:  # noqa: BLE001  not compressed
        try:
            return Y.load(data.decode())
        except Exception as plain:
            raise ValueError(f"neither a compressed nor a plain model: {zstd}; {plain}") from plain
    return Y.load(data.decode())


def imported(spark: SparkSession, path: str) -> Model:
    """A model of an exchange file. Its k-mers are known by hash only: kmer and minimizer are the hashes
    as signed longs, and queries placed with it are hashed in the same way."""
    found = read_exchange(path)
    if "kmersMap" not in found:
        raise ValueError("the model has no k-mers")
    rows = T.flattened(found["root"])
    nodes = spark.createDataFrame([tuple(r.values()) for r in rows], T.NODES)
    inner = {r["node_id"]: r["parent_id"] for r in rows if r["kind"] == T.NODE}

    def clades(ids: list[int]) -> list[tuple[int, bool, bool]]:
        own = sorted((inner[i], i) for i in ids if i in inner)
        return [(n, sum(q == p for q, _ in own) == 1, k == 0 or own[k - 1][0] != p) for k, (p, n) in enumerate(own)]

    def signed(key: int | str) -> int:  # JSON has texts for keys
        h = int(key)
        return h - (1 << 64) if h >= 1 << 63 else h

    kmers = [(signed(b), signed(h), clades(ids)) for b, m in found["kmersMap"]["map"].items() for h, ids in m.items()]
    index = spark.createDataFrame(kmers, f"minimizer long, kmer long, clades {I.CLADES}")
    notes = Y.annotations(spark, found["annotations"]) if found.get("annotations") else None
    return Model(str(found["id"]), found["name"], float(found["minBranchSupport"]), found["kmersMap"]["kSize"], found["kmersMap"]["mSize"], nodes, index, notes, True)
