"""A registry folder with every kind of fault, and counts over groups."""

import hashlib
import json

from pyspark.sql import functions as F

from vecshift.operators import provenance as P


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_folder(spark, tmp_path):
    root = tmp_path / "registry with space"
    (root / "sub").mkdir(parents=True)
    ok = sha(b"x")
    record = lambda i, digest=ok, status="packaged": json.dumps({"id": i, "provenance": {"artifact_sha256": digest, "status": status}})
    files = {
        "evidence.jsonl": "\n".join([record("a"), record("b", None), record("b"), record("c", "12"), record("d", ok, "lost"), record(" ")]).encode(),
        "profiles.jsonl": record("p").encode(), "sub/data.bin": bytes(range(256)), "changed.txt": b"now", "extra.txt": b"", "bare.txt": b"1",
    }
    for name, content in files.items():
        (root / name).write_bytes(content)
    listed = {n: {"sha256": sha(c)} for n, c in files.items() if n != "extra.txt"} | {"gone.txt": {"sha256": ok}}
    listed["changed.txt"]["sha256"] = sha(b"then")
    listed["bare.txt"] = {}
    listed["sub/data.bin"]["sha256"] = listed["sub/data.bin"]["sha256"].upper()
    (root / "manifest.json").write_text(json.dumps({"files": listed, "record_count": 6, "profile_count": 3}, indent=1))
    got = {(r.subject, r.problem) for r in P.verify_folder(spark, str(root)).collect()}
    assert got == {
        ("changed.txt", "changed"), ("extra.txt", "extra"), ("gone.txt", "missing"), ("bare.txt", "no digest"), ("b", "repeated id"), ("c", "not a digest"),
        ("d", "status of retention unknown"), (" ", "no id"), ("profiles", "3 stated, 1 found"),
    }
    found = {r.name: (r.bytes, r.sha256) for r in P.folder(spark, str(root)).collect()}
    assert found["sub/data.bin"] == (256, sha(files["sub/data.bin"])) and found["extra.txt"] == (0, sha(b""))


def test_artifacts(spark):
    c = spark.createDataFrame([(1, "f", sha(b"1").upper()), (2, "f", sha(b"2")), (3, "g", sha(b"1")), (4, None, sha(b"1")), (5, "f", " "), (6, "f", sha(b"1"))], "id int, artifact string, sha256 string")
    f = spark.createDataFrame([("f", sha(b"1"))], "name string, sha256 string")
    assert {r.id: r.status for r in P.artifact_status(c, f).collect()} == {1: "ok", 2: "changed", 3: "not retained", 4: "unstated", 5: "unstated", 6: "ok"}


def test_counts(spark):
    rows = spark.createDataFrame([("s", "t", 0.01, True), ("s", "t", 0.02, None), ("s", None, None, True), (None, "t", -1.0, False)], "source string, target string, gap double, ci boolean")
    d = {(r.grp, r.measure, r.scope): r.value for r in P.derived_counts(rows, [["source", "target"], ["target"]], F.col("gap") < 0).collect()}
    assert d["", "cells", "all"] == 4 and d["", "cells", "kept"] == 3 and d["", "point_estimate", "all"] == 2 and d["", "point_estimate", "kept"] == 1
    assert d["s->t", "cells", "all"] == 2 and d["s->t", "ci_certified", "all"] == 1 and d["s->(none)", "cells", "all"] == 1 and d["t", "cells", "all"] == 3
    assert {k[1] for k in d} == {"cells", "point_estimate", "ci_certified"}  # no columns for the others
    claims = spark.createDataFrame([(1, "s->t", "cells", "all", 2), (2, "s->t", "cells", "all", 3), (3, "u", "cells", "all", 0)], "id int, grp string, measure string, scope string, stated long")
    out = P.count_provenance(claims, P.derived_counts(rows, [["source", "target"]]))
    assert {r.id: r.status for r in out.collect()} == {1: "match", 2: "differs", 3: "underived"}
    assert P.derived_counts(rows.limit(0), []).where("value <> 0").count() == 0
