"""Readers, sinks and the stream on small files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from quarry.operators.merging import entities_of
from quarry.sources import tables as S
from quarry.streaming.ingest import ingest, merged_with
from tests.test_operators import raw_entities


def test_json_readers(spark, tmp_path):
    (tmp_path / "pages.json").write_text(json.dumps([{"page": 1, "text": "a"}, {"page": 2, "text": ""}]))
    assert [tuple(r) for r in S.read_pages(spark, str(tmp_path / "pages.json")).collect()] == [(1, "a")]
    (tmp_path / "g.json").write_text(json.dumps({"entities": [{"id": "a", "name": "A", "aliases": ["x"], "source_pages": [1], "attributes": {"k": "v"}}], "relationships": [{"source": "a", "relation": "R", "target": "b"}]}))
    e, r = S.read_graph(spark, str(tmp_path / "g.json"))
    assert e.first()["aliases"] == ["x"] and r.first()["target"] == "b"
    (tmp_path / "q.json").write_text(json.dumps([{"id": 1, "difficulty": "hard", "question": "q", "answer": "z"}]))
    assert tuple(S.read_questions(spark, str(tmp_path / "q.json")).first()) == (1, "hard", "q", "z")
    (tmp_path / "c.json").write_text(json.dumps([{"chunk_id": 1, "text_preview": "p"}, {"chunk_id": 2, "content": "c"}]))
    assert [r["text"] for r in S.read_chunks(spark, str(tmp_path / "c.json")).orderBy("chunk_id").collect()] == ["p", "c"]
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "chunk_7.json").write_text((tmp_path / "g.json").read_text())
    assert S.read_extractions(spark, str(cache)).first()["chunk_id"] == 7


def test_log_manifest_and_csv(spark, tmp_path):
    (tmp_path / "run.log").write_text("Query 3 ok\nerror: bad\nother\n")
    got = S.read_log(spark, str(tmp_path / "run.log"), {"ok": r"Query (\d+) ok", "error": r"error: (.*)"})
    assert {(r["event"], r["value"]) for r in got.collect()} == {("ok", "3"), ("error", "bad")}
    m = S.manifest(spark, str(tmp_path)).first()
    assert m["digest"] == hashlib.sha256((tmp_path / "run.log").read_bytes()).hexdigest()[:16]
    assert S.folder_size(spark, str(tmp_path)).first()["files"] == 1
    df = spark.createDataFrame([(1, "a\nb", ["x"])], "id int, t string, l array<string>")
    S.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "out")).first()["t"] == "a\nb"


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, S.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_stream_merges_batches(spark, tmp_path):
    e = entities_of(raw_entities(spark))
    for k, part in enumerate((e.where("ord < 2"), e.where("ord >= 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), e.schema).awaitTermination(120)
    got = {r["id"]: r["frequency"] for r in spark.read.parquet(str(tmp_path / "out" / "1")).collect()}
    assert got == {r["id"]: r["frequency"] for r in merged_with(None, e).collect()}
    assert F is not None
