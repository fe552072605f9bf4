import hashlib
import json

import numpy as np

from clausewright.command import main
from clausewright.sources.store import IndexStore


def clause(i, **more):
    text = f"第 {i} 条的正文，足够长而不算损坏。"
    return {"id": f"c{i}", "text": text, "standard": "GB 55031-2022", "article_no": f"3.1.{i + 1}", "kind": "article", "force_status": "全文强制"} | more


def written(folder, rows, vectors=None, **manifest):
    data = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    (folder / "chunks.jsonl").write_text(data, encoding="utf-8")
    kept = [r for r in rows if r["kind"] != "section"]
    vectors = np.eye(len(kept), 8, dtype=np.float32) + 0.1 if vectors is None else vectors
    np.save(folder / "m.npy", vectors)
    given = {"sha1": hashlib.sha1(data.encode()).hexdigest(), "model": "m", "dim": vectors.shape[1], "count": len(vectors), "shape": list(vectors.shape)} | manifest
    (folder / "m.json").write_text(json.dumps(given))
    return ["--chunks", str(folder / "chunks.jsonl"), "--manifest", str(folder / "m.json"), "--matrix", str(folder / "m.npy"), "--model", "m", "--name", "commanded"]


def test_exit_codes(spark, tmp_path, capsys):
    store = IndexStore(spark, "commanded")
    assert main(["verify", "--name", "commanded"], spark) == 1  # nothing published
    good = written(tmp_path, [clause(i) for i in range(4)] + [clause(9, kind="section")] + [clause(5)])
    assert main(["publish", "--json", *good], spark) == 0 and store.live()["count"] == 5
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["dim"] == 8
    assert {r.id: r.embedding[4] > 1 for r in store.open().collect()}["c5"]  # the section has no place in the matrix
    assert main(["verify", "--name", "commanded", "--model", "m", "--json", "--chunks", str(tmp_path / "chunks.jsonl")], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["ok"] is True
    assert main(["verify", "--name", "commanded", "--model", "other"], spark) == 1
    assert main(["standards", "--name", "commanded", "--json"], spark) == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (told["standards"], told["clauses"], told["rows"][0]["n"]) == (1, 5, 5)
    assert main(["standards", "--name", "none"], spark) == 3
    live = store.live()["version"]

    def broken(step):
        if step == "published":
            raise OSError("disk")

    assert main(["publish", *good], spark, broken) == 4 and store.live()["version"] == live
    for wrong in ({"sha1": "0" * 40}, {"model": "other"}, {"count": 4}):
        assert main(["publish", *written(tmp_path, [clause(i) for i in range(5)], **wrong)], spark) == 3
    (tmp_path / "m.json").write_text("{")
    assert main(["publish", *good], spark) == 3
    assert main(["publish", *written(tmp_path, [clause(i) for i in range(5)], np.zeros((5, 8), np.float32))], spark) == 4  # no row finds itself
    assert store.live()["version"] == live and store.open().count() == 5


def test_gate(spark, tmp_path, capsys):
    listed = [("JGJ 38-2015", n, "部分强条") for n in ("6.1.2", "6.1.3", "6.2.1", "6.2.2")] + [("GB 50352-2019", n, "原强条已废止") for n in ("4.3.1", "6.7.4", "6.8.6", "6.8.9")]
    good = [clause(i, standard=s, article_no=n, force_status=f) for i, (s, n, f) in enumerate(listed)]
    path = tmp_path / "c.jsonl"
    for rows, code in ((good, 0), (good + [clause(20, kind="section")], 1), (good[1:], 1), ([good[0] | {"text": " "}, *good[1:]], 1), ([good[0] | {"force_status": "非强条"}, *good[1:]], 1)):
        path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
        assert main(["gate", "--chunks", str(path), "--json"], spark) == code
        assert json.loads(capsys.readouterr().out.splitlines()[-1])["ok"] == (code == 0)
