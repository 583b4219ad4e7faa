"""Documents written line by line and read back."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from cuespan.sources import documents, media
from cuespan.sources import events as ev


def on_disk(folder: str) -> dict:
    return {p.parent.name.split("=", 1)[1]: p.read_text(encoding="utf-8") for p in Path(folder).glob("*/*.txt")}


def test_json_documents_with_two_lists(spark, tmp_path):
    heads = spark.createDataFrame([("a", 1), ("b", None), ("é", 3), (None, 4)], "session string, n int")
    hot = [("a", i, 'say "hi"\n' if i % 2 else None) for i in range(1, 2001)]
    clips = spark.createDataFrame([*hot, ("gone", 1, "x"), (None, 1, "y")], "session string, place int, text string").repartition(6)
    marks = spark.createDataFrame([("é", 2, 0.5), ("é", 1, None)], "session string, at int, t double")
    folder = str(tmp_path / "docs")
    documents.write(documents.json_lines(heads, {"clips": (clips, "place"), "marks": (marks, "at")}), folder)
    got = {k: json.loads(v) for k, v in on_disk(folder).items()}
    assert set(got) == {"a", "b", "é"}
    assert got["a"] == {"session": "a", "n": 1, "clips": [{"text": t} for _, _, t in hot], "marks": []}
    assert got["b"] == {"session": "b", "n": None, "clips": [], "marks": []}
    assert got["é"]["marks"] == [{"t": None}, {"t": 0.5}]
    read = documents.read_json(spark, folder, "session string, clips array<struct<text:string>>").collect()
    assert {r.session: len(r.clips) for r in read} == {"a": 2000, "b": 0, "é": 0}


def test_no_documents(spark, tmp_path):
    heads = spark.createDataFrame([], "session string, n int")
    documents.write(documents.json_lines(heads, {}), str(tmp_path / "none"))
    assert on_disk(str(tmp_path / "none")) == {}


def test_no_array_of_a_document_in_the_plan(spark):
    heads = spark.createDataFrame([("a", 1)], "session string, n int")
    clips = spark.createDataFrame([("a", 1, "x")], "session string, place int, text string")
    plan = documents.json_lines(heads, {"clips": (clips, "place")})._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_text_documents(spark, tmp_path):
    rows = [("a", 2, "two"), ("a", 1, "one"), ("b", 1, "uno"), (None, 1, "left out")]
    lines = spark.createDataFrame(rows, "session string, no long, line string")
    folder = str(tmp_path / "texts")
    documents.write(documents.text_lines(["head", "----"], lines, "no"), folder)
    assert on_disk(folder) == {"a": "head\n----\none\ntwo\n", "b": "head\n----\nuno\n"}
    back = ev.read_lines(spark, documents.files_of(folder)).where("last").collect()
    assert {(r.part_dir, r.pos, r.line) for r in back} == {("document=a", 3, "two"), ("document=b", 2, "uno")}


def test_voice_index_is_read_back_by_its_reader(spark, tmp_path):
    clips = spark.createDataFrame(
        [("s1", "u1", 1, 91.5, "S", "01.m4a"), ("s1", "u1", 2, 70.0, "A", "02.m4a"), ("s2", "u2", 1, 50.0, "B", "01.m4a")],
        "session string, src string, place int, score double, grade string, file string",
    )
    folder = str(tmp_path / "voice")
    documents.write(media.voice_document_lines(clips), folder)
    schema = "session string, n long, clips array<struct<src:string,score:double,grade:string,file:string>>"
    rows = media.voice_scores(spark, documents.files_of(folder), schema).drop("folder", "audio_file")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, clips.drop("place").collect()))


def test_videos_of_a_folder_in_part_order(spark, tmp_path):
    for name in ("game P10.mp4", "game P2.mp4", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.name: r.part_seq for r in media.list_videos(spark, str(tmp_path)).collect()}
    assert got == {"game P2.mp4": 1, "game P10.mp4": 2}


def test_transcripts_and_access_lines_from_files(spark, tmp_path):
    (tmp_path / "a1").mkdir()
    (tmp_path / "a2").mkdir()
    one = {"id": 0, "start": 0.0, "end": 1.0, "text": "hi"}
    (tmp_path / "a1" / "transcript.json").write_text(json.dumps({"game": "g", "sentences": [one]}), encoding="utf-8")
    (tmp_path / "a2" / "transcript.json").write_text(json.dumps([one, one | {"id": 1}], indent=1), encoding="utf-8")
    rows = media.read_transcripts(spark, str(tmp_path / "*" / "transcript.json")).collect()
    assert sorted((r.asr_dir, r.game, r.id) for r in rows) == [("a1", "g", 0), ("a2", None, 0), ("a2", None, 1)]
    (tmp_path / "access.log").write_text("l1\nl2\n", encoding="utf-8")
    assert media.access_log(spark, str(tmp_path / "access.log")).select(F.count("*")).first()[0] == 2
