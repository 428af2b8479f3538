import pytest

from prosemill.operators import rules as R
from prosemill.operators import selftest as T
from prosemill.sources.markup import extract_html, extract_markdown
from prosemill.streaming.weekly import weekly_counts


def rule(i, **kw):
    return {"id": i, "match": {"kind": "regex", "pattern": r"\btestament\s+to\b", "flags": "i"}, "notable": {">": 0}, "tests": {"hit": ["A testament to it."], "miss": ["A will."]}} | kw


def test_resolution():
    old, new = {"name": "a", "rules": [rule("x")]}, {"name": "a", "aliases": ["old"], "rules": [rule("x"), rule("y", default="off")]}
    assert [r["id"] for r in R.resolve([old, new])] == ["x"]
    assert [r["id"] for r in R.resolve([old, new], select=["old"])] == ["x", "y"]
    assert [r["id"] for r in R.resolve([old, new], select=["y"])] == ["y"]
    assert R.resolve([new], tune={"x": {">": 3}})[0]["notable"] == {">": 3}
    with pytest.raises(ValueError):
        R.resolve([new], select=["nothing"])
    with pytest.raises(ValueError):
        R.resolve([{"name": n, "role": "style", "rules": [rule(n)]} for n in "pq"])
    with pytest.raises(ValueError):
        R.validate_set([rule("x"), rule("x")])
    with pytest.raises(ValueError):
        R.validate({"id": "x", "kind": "regex", "pattern": "y"})
    assert R.compare_versions("1.2", "1.10") == -1 and R.compare_versions("1", "1.0") == 0
    assert R.merge_config({"select": ["a"], "ignore": ["b"]}, {"select": ["c"], "ignore": ["b", "d"], "max": 3}) == {"select": ["c"], "ignore": ["b", "d"], "max": 3}


def test_conformance_and_kinds(spark):
    echo = {"id": "e", "match": {"kind": "echo"}, "notable": {">": 0}, "tests": {"hit": ["We saw the old red house. They saw the old red house."], "miss": ["One. Two."]}}
    got = R.conformance(spark, [rule("x"), echo]).collect()
    assert sorted((r.rule, r.label, r.n, r.passed) for r in got) == [("e", "hit", 1, 1), ("e", "miss", 1, 1), ("x", "hit", 1, 1), ("x", "miss", 1, 1)]


def test_markup_does_not_hide_a_hit():
    text = "It is a testament to them."
    start, stop = text.index("testament"), text.index(" them")
    got = T.variants(text, start, stop)
    assert len(got) == 27 and [n for n, _, lossless, _ in got if not lossless] == ["md:code-phrase"]
    for name, form, lossless, source in got:
        out = (extract_html(source) if form == "html" else extract_markdown(source))[0]
        if lossless:
            assert "testament to" in " ".join(out.split()), (name, form, out)


def test_weeks_start_on_mondays(spark):
    d = spark.sql("select timestamp'2024-01-07 23:00:00' ts, 'a' event_type union all select timestamp'2024-01-08 01:00:00', 'a'")
    assert sorted(str(r.week)[:10] for r in weekly_counts(d).collect()) == ["2024-01-01", "2024-01-08"]


def test_self_test_tallies(spark):
    echo = {"id": "e", "match": {"kind": "echo"}, "notable": {">": 0}, "tests": {"hit": ["We saw the old red house. They saw the old red house."], "miss": ["One. Two."]}}
    brittle = {"id": "b", "match": {"kind": "regex", "pattern": "old house"}, "notable": {">": 0}, "tests": {"hit": ["An old house stands."], "miss": ["The old house."]}}
    tested = T.self_test(spark, [rule("x"), echo, brittle, {"id": "n", "match": {"kind": "regex", "pattern": "q"}, "notable": {">": 0}}]).cache()
    got = {r.rule: (r.conform, r.failed, r.fragile) for r in T.tallies(tested).collect()}
    assert got["x"] == (2, 0, 0) and got["e"][:2] == (2, 0) and got["b"] == (1, 1, 2) and got["n"] == (0, 1, 0)
    assert {r.variant for r in T.fragile(tested).collect()} == {"md:double-space", "html:nbsp"}
    assert T.failure_help("fragile: md:soft-wrap") == T.HELP["fragile"]
