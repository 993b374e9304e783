import json
import os
import random

import pytest

from cladeframe import __main__ as cli
from cladeframe import api
from cladeframe.operators import export
from cladeframe.sources import fasta, files, model_store
from cladeframe.sources import yaml_io as Y
from cladeframe.streaming import watcher

TREE = "((a:1,b:1)90:1,((c:1,d:1)80:1,e:1)20:1);"


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("build")
    rng = random.Random(2)
    seqs = {n: "".join(rng.choice("ACGT") for _ in range(80)) for n in "abcde"}
    (at / "t.nwk").write_text(TREE)
    (at / "m.fasta").write_text("".join(f">{n}\n{s[:40]}\n{s[40:]}\n" for n, s in seqs.items()))
    made = api.map_kmers_to_tree(spark, str(at / "t.nwk"), str(at / "m.fasta"), k=15)
    model_store.save(made, str(at / "model"))
    return model_store.load(spark, str(at / "model")), seqs, at


def test_fasta_edges(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a >b\r\nacg-T\r\n\r\nNNac\r\n>empty\n>c\nACGT\n>last\n")
    rows = fasta.read(spark, str(tmp_path / "x.fasta")).orderBy("rec_no").collect()
    assert [(r.rec_no, r.header, r.seq) for r in rows] == [(0, "a b", "ACGTAC"), (1, "empty", ""), (2, "c", "ACGT")]
    (tmp_path / "bad.fasta").write_text("ACGT\n>a\nACGT\n")
    with pytest.raises(Exception, match="before the first header"):
        fasta.read(spark, str(tmp_path / "bad.fasta"), ordered=False).collect()


def test_place_write_and_describe(spark, model, tmp_path):
    made, seqs, at = model
    (tmp_path / "q.fasta").write_text(f">q1\n{seqs['a']}\n>q2\n{seqs['c'][:50]}\n>short\nACG\n>none\n{'AC' * 20}\n")
    notes = Y.annotations(spark, [{"clade": 0, "meta": [Y.load("!SciName Root group")]}, {"clade": 1, "meta": [Y.load("!Taxid 12"), Y.load("!Note two words")]}])
    found = api.place_sequences(spark, str(tmp_path / "q.fasta"), made, notes)
    got = {r.query: r for r in found.collect()}
    assert got["q1"].status == "IdentityFound" and [a.clade for a in got["q1"].annotations] == [0, 1]
    assert got["short"].status == "Error" and got["none"].status == "Unclassifiable"
    out = api.write(found, str(tmp_path / "out" / "r"), "yaml", nodes=made.nodes)
    docs = [Y.load(d) for d in out.read_text().split("---\n")[1:]]
    one = next(d for d in docs if d["query"] == "q1")
    assert one["code"] == "IdentityFound" and [c["name"] for c in one["placement"]["clade"]["children"]] == ["a", "b"]
    assert out.with_suffix(".error").read_text() == "The sequence does not contain enough kmers."
    with pytest.raises(FileExistsError):
        api.write(found, str(tmp_path / "out" / "r"), "yaml")
    lines = {r.query: json.loads(r.line) for r in export.json_lines(found).collect()}
    assert lines["q1"]["placement"]["clade"] == 1 and "placement" not in lines["none"]
    stats = api.describe(made)
    assert stats["KmerSize"] == 15 and stats["kmerCount"] == made.index.count()


def test_exchange_round_trip(spark, model, tmp_path):
    made, seqs, _ = model
    (tmp_path / "q.fasta").write_text(f">q1\n{seqs['a']}\n>q2\n{seqs['c'][:50]}\n>none\n{'AC' * 20}\n")

    def rows(m):
        return sorted((r.query, r.status, r.clade_id, r.one, r.rest) for r in api.place_sequences(spark, str(tmp_path / "q.fasta"), m).collect())

    for form in ("zstd", "yaml", "json"):
        model_store.export(made, str(tmp_path / "m.cls"), form)
        back = model_store.imported(spark, str(tmp_path / "m.cls"))
        assert back.k == 15 and back.index.count() == made.index.count() and back.nodes.count() == made.nodes.count()
    # an imported model knows hashes only, and queries placed with it are hashed
    assert rows(back) == rows(made) and rows(back)[1][1] == "IdentityFound"
    model_store.save(back, str(tmp_path / "again"))
    assert rows(model_store.load(spark, str(tmp_path / "again"))) == rows(made)
    model_store.export(back, str(tmp_path / "n.yaml"), "yaml")
    model_store.export(made, str(tmp_path / "o.yaml"), "yaml")
    assert model_store.read_exchange(str(tmp_path / "n.yaml"))["kmersMap"] == model_store.read_exchange(str(tmp_path / "o.yaml"))["kmersMap"]
    (tmp_path / "bad").write_text("a: [")
    with pytest.raises(ValueError):
        model_store.read_exchange(str(tmp_path / "bad"))


def test_watcher_runs_pending_jobs_once(spark, model, tmp_path):
    made, seqs, at = model
    job = tmp_path / "public" / "j1"
    (job / "input").mkdir(parents=True)
    (job / "input" / "q.fasta").write_text(f">q1\n{seqs['a']}\n>q2\n{seqs['b']}\n")
    inode = os.stat(job / "input" / "q.fasta").st_ino & 0xFFFFFFFF
    assert files.by_inode(str(job), inode).name == "q.fasta"
    (job / "config.yaml").write_text(Y.Job("t", "e", inode, "m1", "j1").text())
    bad = tmp_path / "public" / "j2"
    bad.mkdir()
    (bad / "config.yaml").write_text(Y.Job("t", "e", 1, "none", "j2").text())
    service = Y.Service({"serveDirectory": str(tmp_path)}, [{"id": "m1", "name": "m", "modelPath": str(at / "model")}])
    for _ in range(2):
        watcher.watch(spark, str(tmp_path), service, str(tmp_path / "state"), once=True).awaitTermination()
    assert (job / "success.yaml").exists() and (job / "running.yaml").exists()
    assert (job / "output" / "result.yaml").read_text().count("---\n") == 2
    assert "model not found" in (bad / "error.yaml").read_text()
    assert [r.name for r in files.listing(spark, str(job / "input")).collect()] == ["q.fasta"]


def test_parallel_results(spark, model, tmp_path):
    made, seqs, _ = model
    (tmp_path / "q.fasta").write_text(f">q1\n{seqs['a']}\n>short\nACG\n")
    found = api.place_sequences(spark, str(tmp_path / "q.fasta"), made)
    api.write_parallel(found, str(tmp_path / "out"))
    (line,) = spark.read.text(str(tmp_path / "out" / "result")).collect()
    assert json.loads(line.value)["query"] == "q1"
    assert spark.read.text(str(tmp_path / "out" / "error")).count() == 1
    with pytest.raises(Exception, match="already exists"):
        api.write_parallel(found, str(tmp_path / "out"))


def test_command_line_parses():
    args = cli.parser().parse_args(["place", "q.fasta", "-d", "m", "-o", "r", "-r"])
    assert args.iterations == 1000 and args.remove_intersection and not args.parallel
    assert cli.parser().parse_args(["convert", "tree", "t.nwk"]).min_branch_support == 95


def test_uploads(tmp_path):
    name = files.new_work_dir(str(tmp_path))
    files.store(str(tmp_path), name, "../q.fasta", b">a\nACGT\n")
    with pytest.raises(FileExistsError):
        files.store(str(tmp_path), name, "q.fasta", b"")
    assert files.store(str(tmp_path), name, "q.fasta", b"", force=True).read_bytes() == b""
