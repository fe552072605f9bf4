import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from clausewright.operators.citations import verify
from clausewright.sources.chunks import fingerprint, positioned_chunks, read_chunks, read_marked_text
from clausewright.sources.embedded import EmbeddingCache
from clausewright.sources.matrix import ManifestError, cache_state, matrix_shape, read_manifest, read_matrix, with_vectors
from clausewright.sources.npy import MatrixReader
from clausewright.sources.store import GateError, IndexStore, Manifest, PublishError, manifest_problems, model_of, row_payload, store_by_question


def rows(spark, n, dim=4):
    return spark.createDataFrame([(i, [float(i + 1), 0.0, 0.0, 1.0][:dim]) for i in range(n)], "id int, embedding array<double>")


def given(n, **more):
    return {"sha1": "x", "model": "m", "dim": 4, "count": n, "shape": [n, 4]} | more


def test_publish_gate_and_failure(spark):
    store = IndexStore(spark, "clauses_a")
    assert store.live() is None and store.problems() == ["nothing published"]
    first = store.publish(rows(spark, 5), Manifest("x", "m", 4, 5), given(5))
    assert store.open("m", 4, "x").count() == 5
    with pytest.raises(GateError) as gate:
        store.publish(rows(spark, 3), Manifest("y", "m", 4, 3), given(3))
    with pytest.raises(GateError):
        store.publish(rows(spark, 4), Manifest("x", "m", 4, 3), given(3))
    with pytest.raises(PublishError) as failed:
        store.publish(rows(spark, 3, 3), Manifest("x", "m", 4, 3), given(3))
    assert (gate.value.exit_code, failed.value.exit_code) == (3, 4)
    assert store.open().count() == 5 and store.live()["version"] == first
    store.publish(rows(spark, 3), Manifest("x", "it's", 4, 3), given(3, model="it's"))
    assert store.open().count() == 3 and store.live()["count"] == 3 and store.live()["model"] == "it's"
    assert len(store.vacuum(keep=1)) == 1 and store.vacuum(keep=0) == [first] and store.open().count() == 3
    for wrong in ({"model": "other"}, {"dim": 5}, {"sha1": "y"}):
        with pytest.raises(GateError):
            store.open(**wrong)


@pytest.mark.parametrize("step", ["written", "verified", "published"])
def test_a_fault_leaves_the_old_version_live(spark, step):
    store = IndexStore(spark, f"clauses_{step}")

    def fault(at):
        if at == step:
            raise OSError(step)

    with pytest.raises(OSError):
        store.publish(rows(spark, 2), Manifest("x", "m", 4, 2), given(2), at=fault)
    assert store.live() is None
    version = store.publish(rows(spark, 5), Manifest("x", "m", 4, 5), given(5))
    with pytest.raises(OSError):
        store.publish(rows(spark, 3), Manifest("x", "m", 4, 3), given(3), at=fault)
    assert store.live()["version"] == version and store.open().count() == 5
    assert len(store.vacuum(keep=5)) == 2 and store.open().count() == 5


def test_manifest():
    assert manifest_problems(None, "x", "m", 3) and manifest_problems({}, "x", "m", 3)
    assert manifest_problems(given(3), "x", "m", 3, 4) == []
    assert manifest_problems(given(3, dim=True), "x", "m", 3) and manifest_problems(given(3, shape=[4, 3]), "x", "m", 3)
    assert model_of(None) is None and model_of({"model": " "}) is None and model_of(given(3)) == "m"
    assert cache_state(given(3), True, "x", "m", 3) == (True, []) and cache_state(given(3), False, "x", "m", 3) == (False, ["matrix missing"])


def test_matrix(spark, tmp_path):
    assert read_manifest(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(ManifestError):
        read_manifest(spark, str(tmp_path / "broken.json"))
    (tmp_path / "m.json").write_text(json.dumps(given(5)))
    manifest = read_manifest(spark, str(tmp_path / "m.json"))
    assert manifest == given(5)
    folder = tmp_path / "parts"
    folder.mkdir()
    matrix = np.arange(20, dtype=np.float32).reshape(5, 4)
    np.save(folder / "a.npy", matrix[:3])
    np.save(folder / "b.npy", matrix[3:])
    assert [r.embedding for r in read_matrix(spark, str(folder)).orderBy("pos").collect()] == matrix.tolist()
    own = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "pos long, id string")
    got = with_vectors(own, manifest, str(folder), "x", "m", 4).orderBy("pos").collect()
    assert [(r.id, r.embedding) for r in got] == [(f"r{i}", matrix[i].tolist()) for i in range(5)]
    np.save(tmp_path / "flat.npy", matrix.ravel())
    with pytest.raises(ManifestError, match="dimensions"):
        matrix_shape(str(tmp_path / "flat.npy"))
    with pytest.raises(Exception, match="dimensions"):
        read_matrix(spark, str(tmp_path / "flat.npy")).count()
    for wrong in ((own.filter("pos < 4"), manifest, folder), (own, given(5, model="o"), folder), (own, manifest, tmp_path / "none"), (own, manifest, folder / "a.npy"), (own.withColumn("pos", own.pos + 1), manifest, folder)):
        with pytest.raises(GateError):
            with_vectors(wrong[0], wrong[1], str(wrong[2]), "x", "m")


def test_matrix_by_ranges(spark, tmp_path):
    want = np.arange(9_000 * 5, dtype=np.float64).reshape(9_000, 5)
    folder = tmp_path / "parts"
    folder.mkdir()
    np.save(folder / "a.npy", want[:4_000].astype(np.float32))
    np.save(folder / "b.npy", np.asfortranarray(want[4_000:8_000]))
    np.save(folder / "c.npy", want[8_000:].astype(np.int32))
    (folder / "_SUCCESS").write_text("")
    assert matrix_shape(str(folder)) == (9_000, 5) == matrix_shape(f"file://{folder}") and matrix_shape(str(tmp_path / "none")) is None
    found = read_matrix(spark, str(folder), range_bytes=10_000)
    assert found.rdd.getNumPartitions() == sum(-(-rows // (10_000 // size)) for rows, size in ((4_000, 20), (4_000, 40), (1_000, 20)))
    assert [r.embedding for r in found.orderBy("pos").collect()] == want.tolist()
    np.save(folder / "d.npy", want[:, :2])
    with pytest.raises(ManifestError, match="width"):
        matrix_shape(str(folder))
    np.save(tmp_path / "text.npy", np.array([["a"]]))
    (tmp_path / "cut.npy").write_bytes((folder / "a.npy").read_bytes()[:-1])
    (tmp_path / "none.npy").write_text("no matrix")
    for name, why in (("text", "plain"), ("cut", "cut off"), ("none", "no header")):
        with pytest.raises(ManifestError, match=why):
            matrix_shape(str(tmp_path / f"{name}.npy"))


def test_matrix_beyond_two_gigabytes(spark, tmp_path):
    rows, dim = 2_300_000, 256  # 2.36 GB, of which the disk holds only the end
    with open(tmp_path / "large.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (rows, dim)})
        f.seek(f.tell() + (rows - 1) * dim * 4)
        f.write(np.full(dim, 7, "<f4").tobytes())
    reader = MatrixReader(str(tmp_path / "large.npy"), 64 << 20)
    parts = reader.partitions()
    assert len(parts) > 30 and sum(p.count for p in parts) == rows
    *_, last = reader.read(parts[-1])
    assert last.column(0)[-1].as_py() == rows - 1 and last.column(1)[-1].as_py() == [7.0] * dim
    assert read_matrix(spark, str(tmp_path / "large.npy")).rdd.getNumPartitions() == len(parts)


def test_rows_are_made_once_while_they_are_written(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    once = rows(spark, 6).mapInArrow(count, "id int, embedding array<double>")
    store = IndexStore(spark, "clauses_once")
    store.publish(once, Manifest("x", "m", 4, 6), given(6))
    assert made.value == 6 and store.open().count() == 6
    with pytest.raises(GateError, match="6 rows, not 5"):
        IndexStore(spark, "clauses_none").publish(once, Manifest("x", "m", 4, 5), given(5))
    assert not spark.sql("SHOW TABLES LIKE 'clauses_none*'").count()


def test_counts_while_reading(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "kind": "section"}\n\n{"id": "b", "kind": "article"}\n{"id": "c"}\n{"id": "d", "kind": "section"}\n')
    seen = Observation()
    read_chunks(spark, str(tmp_path / "c.jsonl"), seen).write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 4, "dropped": 2}


def test_positions_in_a_file(spark, tmp_path):
    lines = ["" if i % 7 == 0 else json.dumps({"id": str(i), "kind": "section" if i % 5 == 0 else None}) for i in range(500)]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    found = positioned_chunks(spark, str(tmp_path / "c.jsonl"), segment=16).orderBy("pos").collect()
    assert [(r.pos, r.id) for r in found] == list(enumerate(str(i) for i in range(500) if i % 7 and i % 5))


def test_payload(spark):
    one = spark.createDataFrame([("a", "t", None, 3, [1.0])], "id string, text string, chapter string, page int, embedding array<double>")
    assert row_payload(one).first().asDict(recursive=True) == {"id": "a", "text": "t", "meta": {"chapter": "", "page": 3}}
    shown = row_payload(one, lambda name, column: F.concat(F.lit(f"{name}="), F.coalesce(column.cast("string"), F.lit("?"))))
    assert shown.first().meta.asDict() == {"chapter": "chapter=?", "page": "page=3"}


def test_only_new_texts_are_encoded(spark):
    calls = spark.sparkContext.accumulator(0)

    def encoder():
        return lambda texts: [(calls.add(1), [float(len(t)), 1.0])[1] for t in texts]

    cache = EmbeddingCache(spark, "embedded")
    clauses = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "bb"), (5, "")], "id int, text string")
    got = {r.id: r.embedding for r in cache.embed(clauses, encoder, "m").collect()}
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [0.0, 1.0], 4: [2.0, 1.0], 5: [0.0, 1.0]} and calls.value == 3
    changed = clauses.filter("id <> 1").union(spark.createDataFrame([(1, "ccc")], "id int, text string"))
    assert {r.id: r.embedding[0] for r in cache.embed(changed, encoder, "m").collect()}[1] == 3.0 and calls.value == 4
    assert cache.embed(clauses, encoder, "m").count() == 5 and calls.value == 4
    assert cache.embed(clauses, encoder, "other").count() == 5 and calls.value == 7
    assert cache.embed(clauses.limit(0), encoder, "m").count() == 0 and calls.value == 7


def test_stored_answers_are_verified_without_an_exchange(spark):
    found = spark.createDataFrame([(q, r, f"GB 5000{r}-2019", "6.1.1", 0.5) for q in range(20) for r in (1, 2)], "qid int, rank int, standard string, article_no string, score double")
    answers = spark.createDataFrame([(q, "【GB 50001-2019】第 6.1.1 条。" if q % 2 else "见第 9.9.9 条。") for q in range(20)], "qid int, answer string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = verify(store_by_question(answers, "kept_answers", 4), store_by_question(found, "kept_hits", 4))
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
        assert {(r.qid, r.ok) for r in kept.collect()} == {(r.qid, r.ok) for r in verify(answers, found).collect()} == {(q, q % 2 == 1) for q in range(20)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "kind": "section"}\n\n{"id": "b", "kind": "article"}\n{"id": "c"}\n')
    assert {r.id for r in read_chunks(spark, str(tmp_path / "c.jsonl")).collect()} == {"b", "c"}
    assert len(fingerprint(spark, str(tmp_path / "c.jsonl")).first().sha1) == 40
    (tmp_path / "t.md").write_text("a\nb")
    assert [r.text for r in read_marked_text(spark, str(tmp_path / "t.md")).orderBy("line").collect()] == ["a", "b"]
