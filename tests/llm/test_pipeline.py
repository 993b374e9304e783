import random

import corpus_pipeline

WORDS = "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "ly"]) for _ in range(n))


def test_stages_in_order_and_effects(spark, tmp_path):
    rng = random.Random(1)
    clean = [prose(rng, 100) for _ in range(30)]
    passage = "\n".join(prose(rng, 20) for _ in range(4))
    item = prose(rng, 25)
    texts = [*clean, clean[0], "### " * 90, clean[1] + "\n" + passage, prose(rng, 90) + "\n" + passage, prose(rng, 90) + " " + item]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(31, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id: r.text for r in out}
    assert {30, 31, 34}.isdisjoint(left) and not (passage in left.get(33, ""))
    words = sum(len(r.text.split()) for r in out)
    assert abs(words - 1.5 * sum(len(t.split()) for t in {d: t for d, t in left.items()}.values())) < 0.2 * words
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "mixture"]


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, at, rows, labels, items, extra=""):
    spark.createDataFrame(rows, KIND + extra).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(2)
    long = [prose(rng, 80) for _ in range(12)]
    rows = [(k, t, None if k % 4 else "en", None if k % 3 else "s", None, "x", "y", 1, 2) for k, t in enumerate(long)]
    rows += [rows[0], rows[0], (None, long[1], None, None, None, None, None, None, None), (None, prose(rng, 80), None, None, None, None, None, None, None), (50, None, "en", "s", 0, "x", "y", 1, 2), (51, "", "en", "s", 0, "x", "y", 1, 2), (52, prose(rng, 5), "en", "s", 0, "x", "y", 1, 2)]
    tables(spark, tmp_path, rows, [(0, 1, None), (None, 1, 0), (3, None, None)], [(0, None), (1, ""), (None, prose(rng, 30))], ", fp string, own string, shard int, size long")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:9] == ["doc_id", "text", "lang", "source", "n_chars", "fp", "own", "shard", "size"]
    left = {r.doc_id for r in out.collect()}
    assert not {50, 51, 52} & left and left <= {None, *range(12)}
    # a repeated row counts once, whatever the mix takes of it
    assert out.where("doc_id = 0").count() <= 2
