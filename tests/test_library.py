import io
import json

import pytest

from prosemill.operators import library as L
from prosemill.operators import rules as R
from prosemill.plans import rulebook
from prosemill.sources import report


def rule(i, **kw):
    return {"id": i, "match": {"kind": "regex", "pattern": r"\btestament\s+to\b", "flags": "i"}, "notable": {">": 0}, "tests": {"hit": ["A testament to it."], "miss": ["A will."]}} | kw


def test_building_and_import():
    assert R.widened(r"in order[ x]to\ be [a \] b]") == r"in\s+order[ x]to\ be\s+[a \] b]"
    built = R.build_rule(rule("a", match={"kind": "regex", "pattern": "a b"}, notable={">=": 1.0, "per": 1000}))
    assert built["match"]["pattern"] == r"a\s+b" and built["notable"]["needs"] == {"words": 80, "sentences": 3, "matches": 2}
    assert "needs" not in R.build_rule(rule("a", notable={"<=": 1.0, "per": 1000}))["notable"]
    made, version = L.word_list_rule(rule("a"), ["x", "c++"], "1.0.9")
    assert made["match"]["pattern"] == r"\b(?:x|c\+\+)\b" and version == "1.0.10"
    got, kinds = L.import_rules([rule("a"), rule("b")], {"a": {"default": "off"}}, {"b": "say less"}, {"a": "noisy"})
    assert (got[0]["default"], got[0]["note"], got[1]["suggest"], kinds) == ("off", "noisy", "say less", {"regex": 2})
    with pytest.raises(ValueError):
        L.import_rules([rule("a")], {"c": {}})


def test_library_life(spark, tmp_path):
    home, day = str(tmp_path), "2024-05-01"
    b, a = {"name": "b", "version": "1.0", "rules": [rule("x")]}, {"name": "a", "version": "2.0", "rules": [rule("y")]}
    assert L.install(b, "here/b.json", home, day, spark)["failing"] == 0
    L.install(a, "here/a.json", home, day)
    assert list(json.loads((tmp_path / "lock.json").read_text())["sets"]) == ["a", "b"]
    assert [s["name"] for s in L.installed(home)] == ["a", "b"]
    bad = {"name": "c", "rules": [rule("z", tests={"hit": ["nothing here"], "miss": []})]}
    with pytest.raises(ValueError):
        L.install(bad, "c", home, day, spark)
    assert L.install(bad, "c", home, day, spark, force=True)["failing"] == 1
    assert L.uninstall("c", home) and not L.uninstall("c", home)
    with pytest.raises(ValueError):
        L.uninstall("../a", home)
    (tmp_path / "a.json").unlink()
    assert L.drift(home) == [("a", "missing"), ("b", "same")]
    assert L.drift(home, [a | {"version": "2.1"}, b | {"rules": [rule("w")]}, bad]) == [("a", "newer"), ("b", "changed"), ("c", "unlocked")]
    assert L.restore(home, lambda source: a | {"rules": [rule("w")]}, day) == [("a", "held back")]
    assert L.restore(home, lambda source: a, day) == [("a", "restored")] and L.restore(home, None, day) == []


def test_rule_reports(spark):
    sets = [{"name": "a", "version": "1.0", "rules": [rule("x"), rule("y", default="off")]}]
    assert [(r.rule, r.active, r.bounds) for r in L.rule_rows(spark, sets).collect()] == [("x", True, "> 0"), ("y", False, "> 0")]
    assert [(r.rules, r.active) for r in L.set_rows(spark, sets).collect()] == [(2, 1)]
    assert L.explain(sets, "y")["set"] == "a"
    with pytest.raises(ValueError):
        L.explain(sets, "z")


def test_rulebook(spark):
    active = R.resolve(rulebook.SETS, everything=True)
    assert len(active) == 69 and len(R.resolve(rulebook.SETS)) == 40
    texts = ["It stands as a testament to craft. Many experts argue so.", "No frills, no fuss, and no waste.", "The plan is simple and clear."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fired = {(r.doc_id, r.rule) for r in R.evaluate(d, active).where("fires").collect()}
    assert fired == {(0, "testament"), (0, "vague-experts"), (0, "machine-phrases"), (1, "no-chain")}


def test_report_lines(spark):
    schema = "file string, line int, col int, rule string, match string, sentence string, suggest string, count int, measure string, occurrences array<struct<line:int,col:int,context:string>>"
    found = spark.createDataFrame([("f", 3, 5, "r", "a  b", "x a b y", "cut", 2, None, None), ("f", 1, 1, "d", "m", "s", None, None, "9 per 1000", [(k, k, f"c{k}") for k in range(7)])], schema)
    stats = spark.createDataFrame([("f", 120), ("g", 7)], "file string, ws_words long")
    got = [r.line for r in report.report_lines(found, stats, context=True, suggest=True).orderBy("file", "place").collect()]
    assert got[0] == "f (120 words, 2 findings)"
    assert got[1].split() == ["document", "d", "9", "per", "1000"] and len(got) == 1 + 8 + 3
    assert [x.split() for x in got[9:]] == [["3:5", "r", "×2", "a", "b"], ["x", "a", "b", "y"], ["fix:", "cut"]]
    short = [r.line for r in report.report_lines(found, stats).orderBy("file", "place").collect()]
    assert len(short) == 1 + 7 + 1 and short[7].strip() == "… 2 more"
    assert report.report_lines(found.limit(0), stats).count() == 0


def test_budget_exit():
    assert [report.budget_exit(2.0, 9), report.budget_exit(2.0, 9, 1.0), report.budget_exit(2.0, 9, 3.0, 1), report.budget_exit(2.0, 9, None, 8), report.budget_exit(2.0, 9, 1.0, exit_zero=True)] == [0, 1, 0, 1, 0]


def test_read_url(spark):
    class Answer(io.BytesIO):
        headers = {"Content-Type": "text/plain; charset=utf-8"}

    assert report.read_url(spark, "https://x.test/a", lambda url: Answer("é".encode())).first() == ("https://x.test/a", "é", "txt")
    with pytest.raises(ValueError):
        report.read_url(spark, "file:///etc/hosts")
    with pytest.raises(ValueError):
        report.read_url(spark, "http://x.test", lambda url: Answer(b"abc"), most=2)
