"""Targets, payloads, rule-set files, configuration, day windows and snapshots."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from prosemill.operators import corpus
from prosemill.sources import files, inputs

RULE = {"id": "x", "match": {"kind": "regex", "pattern": "y"}, "notable": {">": 0}}


def test_targets(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("﻿one", "utf-8")
    (tmp_path / "sub" / "b.txt").write_text("two")
    (tmp_path / "skip.bin").write_bytes(b"\0")
    with pytest.raises(ValueError):
        inputs.read_targets(spark, [str(tmp_path)])
    with pytest.raises(FileNotFoundError):
        inputs.read_targets(spark, [str(tmp_path / "none.md")])
    got = inputs.read_targets(spark, [str(tmp_path), "-"], recursive=True, stdin=io.StringIO("three"))
    assert sorted((r.src, r.kind) for r in got.collect()) == [("one", "md"), ("three", "md"), ("two", "txt")]
    assert [r.src for r in inputs.read_targets(spark, [str(tmp_path / "a.md")]).collect()] == ["one"]
    monkeypatch.chdir(tmp_path)
    assert inputs.read_targets(spark, ["."]).count() == 2


def test_drop_reads_archives_and_counts_the_rest(spark, tmp_path):
    (tmp_path / "b.md").write_text("two")
    (tmp_path / "x.png").write_bytes(b"\1")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/a.txt", "one")
        z.writestr("__MACOSX/a.txt", "no")
        z.writestr("in/.b.txt", "no")
        z.writestr("in/c.bin", "no")
    rows, skipped = inputs.read_drop(spark, str(tmp_path))
    assert [r.src for r in rows.collect()] == ["one", "two"] and skipped.first().skipped == 1


def test_payloads_come_back(spark):
    one = inputs.share_link("http://x", [("a.md", "héllo", "md")], select=["s"], ignore=["i", "j"], rules=["http://r/s.json", "local.json"])
    rows, options = inputs.read_payload(spark, one[0])
    assert [tuple(r) for r in rows.collect()] == [("a.md", "héllo", "md")] and options == {"select": ["s"], "ignore": ["i", "j"], "rules": ["http://r/s.json"]} and not one[1]
    many = inputs.share_link("http://x/", [("a", "1", "md"), ("b", "2", "html")])
    assert [tuple(r) for r in inputs.read_payload(spark, many[0])[0].collect()] == [("a", "1", "md"), ("b", "2", "html")]
    assert tuple(inputs.read_payload(spark, "http://x/#text=aGVsbG8gdGhlcmU&kind=txt")[0].first()) == ("shared", "hello there", "txt")
    assert inputs.read_payload(spark, "http://x/#text=w6kg8J-YgA")[0].first().src == "é 😀"
    # of several, the bundle comes before gz, gz before text, text before url
    assert inputs.read_payload(spark, one[0] + "&text=aGVsbG8&url=http%3A%2F%2Fnowhere.invalid")[0].first().src != "hello"
    assert inputs.read_payload(spark, "http://x/")[0].count() == 0
    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=150_000))
    assert inputs.share_link("http://x/", [("a", noise, "md")])[1]


def test_sets_and_manifests(tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"name": "one", "rules": [RULE]}))
    (tmp_path / "bare.json").write_text(json.dumps([RULE]))
    (tmp_path / "all.json").write_text(json.dumps({"sets": ["one.json", "bare.json", {"name": "inside", "rules": [RULE]}]}))
    assert sorted(s["name"] for s in inputs.load_sets(str(tmp_path / "all.json"))) == ["bare", "inside", "one"]
    with pytest.raises(ValueError, match="line 2, column"):
        inputs.parse_set('{"rules":\n oops}')
    with pytest.raises(ValueError, match="list of rules"):
        inputs.parse_set("3")


def test_configuration_is_looked_for_upwards(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert inputs.load_config(None) == {}
    (tmp_path / "prose.json").write_text('{"max": 3}')
    assert inputs.load_config(inputs.find_config(str(tmp_path / "a" / "b"))) == {"max": 3}
    (tmp_path / "prose.json").write_text("{")
    with pytest.raises(ValueError):
        inputs.load_config(str(tmp_path / "prose.json"))


def test_day_windows_lie_apart(spark):
    days = spark.sql("select date'2025-01-01' as day union all select date'2025-01-02'")
    rows = files.day_windows(days).orderBy("day", "window").collect()
    assert len(rows) == 20 and all(r.start_second >= r.window * 8640 and r.start_second + r.seconds <= (r.window + 1) * 8640 for r in rows)
    # the generator by hand, in doubles
    h = 0
    for c in "2025-01-01":
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    want = []
    for i in range(10):
        h = int(float(h) * 1103515245.0 + 12345.0) & 0xFFFFFFFF
        want.append((i * 8_640_000 + int(h / 4294967296 * (8_640_000 - 300_000))) // 1000)
    assert [r.start_second for r in rows[:10]] == want


def test_records_absent_or_empty_are_none(spark, tmp_path):
    assert files.read_records(spark, str(tmp_path / "none.jsonl")) is None
    (tmp_path / "day.jsonl").write_text('{"ts": "t", "author": "a", "body": "b"}\n{"ts": "t", "auth')
    assert [r.body for r in files.read_records(spark, str(tmp_path / "day.jsonl")).collect()] == ["b"]
    (tmp_path / "empty.jsonl").write_text("")
    assert files.read_records(spark, str(tmp_path / "empty.jsonl")) is None


def test_snapshots(spark, tmp_path):
    (tmp_path / "1.js").write_text('window.x = {"generated": "2025-01-02", "components": [{"lead": false, "word_list": ["no"]}, {"lead": true, "word_list": ["a", "b"]}]};\n')
    (tmp_path / "2.js").write_text("nothing here")
    got = sorted((str(r.generated), r.word, r["rank"]) for r in inputs.read_snapshots(spark, str(tmp_path)).collect())
    assert got == [("2025-01-02", "a", 1), ("2025-01-02", "b", 2)]


@pytest.mark.parametrize(
    ("body", "text", "footer"),
    [
        ("A\n\nGenerated with X\n\nCo-authored-by: Y", "A\n", "Generated with X\n\nCo-authored-by: Y"),
        ("A\nGenerated with X\nB\nAssisted by Y", "A\nGenerated with X\nB", "Assisted by Y"),
        ("A\nGenerated with X\nB", "A", "Generated with X\nB"),
        ("<!-- A_B_C -->\nA", " \nA", "<!-- A_B_C -->"),
        ("A", "A", ""),
        ("", "", ""),
        ("Generated with X\n" + "l\n" * 9, "Generated with X\n" + "l\n" * 9, ""),
    ],
)
def test_footers_end_a_text(spark, body, text, footer):
    got = spark.createDataFrame([(body,)], "b string").select(corpus.split_footer(F.col("b")).alias("s")).first().s
    assert (got.text, got.footer) == (text, footer)


def test_pooling_stops_at_a_break(spark):
    rows = [("2025-01-03", "a", 1), ("2025-01-03", "b", 2), ("2025-01-02", "b", 1), ("2025-01-02", "a", 2), ("2025-01-02", "c", 3), ("2025-01-01", "x", 1), ("2025-01-01", "y", 2), ("2025-01-01", "a", 3)]
    s = spark.createDataFrame(rows, "generated string, word string, rank int")
    assert [(r.word, r.n, r.place) for r in corpus.pooled(s).orderBy("place").collect()] == [("a", 2, 1), ("b", 2, 2)]
    gate = lambda had, **kw: corpus.churn_gate(spark.createDataFrame([(w,) for w in had], "word string"), corpus.pooled(s), **kw).first().outcome
    assert gate(["a", "b"]) == "same" and gate(["z"]) == "refused" and gate(["z"], bootstrap=True) == "write" and gate([]) == "write"
