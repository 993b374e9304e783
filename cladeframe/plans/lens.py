"""A view of the test tables as placement inputs: texts, cleaned, are sequences; languages and sources are clades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import tree as T
from ..runtime import spread

K, M, MIN_SUPPORT = 12, 4, 70.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_no, header, seq) of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("rec_no"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("header"), S.sanitize(F.coalesce("text", F.lit(""))).alias("seq"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, seq): every benchmark item, and every document whose number is divisible by 50."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("query"), S.sanitize(F.coalesce("text", F.lit(""))).alias("seq"))
    own = records(spark, sf_dir).where("rec_no % 50 = 0").select(F.col("header").alias("query"), "seq")
    return items.unionByName(own)


def clades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Languages (lang, node_id) and sources (lang, source, parent_id, node_id, support)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    langs = docs.select("lang").distinct().withColumn("node_id", F.dense_rank().over(Window.orderBy("lang")).cast("long"))
    support = docs.select("doc_id", "lang", "source").join(labels.select("doc_id", "quality"), "doc_id", "left").groupBy("lang", "source").agg((100 * F.avg("quality")).alias("support"))
    rank = (F.dense_rank().over(Window.orderBy("lang", "source")) + 99).cast("long")
    sources = support.withColumn("node_id", rank).join(langs.withColumnRenamed("node_id", "parent_id"), "lang")
    return langs, sources


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, languages, sources of a language, documents."""
    langs, sources = clades(spark, sf_dir)
    none, order = F.lit(None), F.lit(None).cast("int").alias("child_ord")

    def row(df: DataFrame, node, parent, kind: str, name, support, length) -> DataFrame:
        return df.select(node.cast("long").alias("node_id"), parent.cast("long").alias("parent_id"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), support.cast("double").alias("support"), length.cast("double").alias("length"), order)

    root = row(spark.range(1), F.lit(0), none, T.ROOT, none, none, F.lit(0.0))
    first = row(langs, F.col("node_id"), F.lit(0), T.NODE, none, none, F.lit(1.0))
    second = row(sources, F.col("node_id"), F.col("parent_id"), T.NODE, none, F.col("support"), F.lit(1.0))
    docs = table(spark, sf_dir, "documents").join(sources.select("lang", "source", "node_id"), ["lang", "source"])
    leaves = row(docs, F.col("doc_id") + 1000, F.col("node_id"), T.LEAF, F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), none, F.lit(1.0))
    return root.unionByName(first).unionByName(second).unionByName(leaves)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag for each language and each source."""
    langs, sources = clades(spark, sf_dir)

    def tag(name: str, value: str):
        return F.array(F.struct(F.lit(name).alias("tag"), F.col(value).alias("value")))

    return langs.select(F.col("node_id").alias("clade"), tag("SciName", "lang").alias("meta")).unionByName(sources.select(F.col("node_id").alias("clade"), tag("Rank", "source").alias("meta")))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of regions, nations and customers, for tree operators; a nation's support is its mean balance, up to 100."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    order = F.lit(None).cast("int").alias("child_ord")
    none = F.lit(None)

    def row(df, node, parent, kind, name, support):
        return df.select(node.cast("long").alias("node_id"), parent.cast("long").alias("parent_id"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), support.cast("double").alias("support"), F.lit(1.0).alias("length"), order)

    support = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.avg("c_acctbal") / 50, 0).alias("support"))
    out = row(spark.range(1), F.lit(0), none, T.ROOT, none, none)
    out = out.unionByName(row(region, F.col("r_regionkey") + 1, F.lit(0), T.NODE, none, F.lit(99.0)))
    out = out.unionByName(row(nation.join(support, "n_nationkey", "left"), F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, T.NODE, none, F.col("support")))
    return out.unionByName(row(customer, F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, T.LEAF, F.col("c_name"), none))
