"""Versioned publication: writers that meet, repeated attempts, equal rows; containment of rules without all pairs."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from prosemill.operators import evaluate
from prosemill.sources import publication


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/history"


def rows(spark, *triples):
    return spark.createDataFrame(triples, "built string, word string, rank int")


def held(spark, path, version=None):
    return sorted(map(tuple, publication.read(spark, path, version).collect()), key=str)


def test_the_latest_wins_and_versions_stay(spark, path):
    assert publication.current(spark, path) is None and publication.read(spark, path) is None
    publication.upsert(rows(spark, ("w1", "a", 1), ("w1", "b", 2), ("w2", "a", 1)), path, "built")
    publication.upsert(rows(spark, ("w2", "c", 1), ("w3", "d", 1)), path, "built")
    assert held(spark, path) == [("w1", "a", 1), ("w1", "b", 2), ("w2", "c", 1), ("w3", "d", 1)]
    assert held(spark, path, 1) == [("w1", "a", 1), ("w1", "b", 2), ("w2", "a", 1)]


def test_equal_rows_and_repeated_attempts_publish_nothing(spark, path):
    one = rows(spark, ("w1", "a", 1), ("w1", None, 2))
    publication.upsert(one, path, "built", token="monday")
    publication.upsert(one.repartition(3), path, "built")
    publication.upsert(rows(spark, ("w9", "late", 1)), path, "built", token="monday")
    assert [v["version"] for v in publication.versions(spark, path)] == [1] and len(held(spark, path)) == 2


def test_a_number_is_taken_once(spark, path):
    publication.upsert(rows(spark, ("w1", "a", 1)), path, "built")
    before = publication.current(spark, path)
    a, b = publication.stage(rows(spark, ("w1", "b", 1)), path), publication.stage(rows(spark, ("w1", "c", 1)), path)
    publication.swap(spark, path, a, before)
    with pytest.raises(publication.Conflict):
        publication.swap(spark, path, b, before)
    assert held(spark, path) == [("w1", "b", 1)]


def test_concurrent_writers_lose_nothing(spark, path):
    """Four writers of four keys and of one that they share: all keys are there, and one outcome of the shared one."""

    def write(k):
        publication.upsert(rows(spark, (f"w{k}", "own", k), ("shared", "by", k)), path, "built")

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = held(spark, path)
    assert [r for r in got if r[0] != "shared"] == [(f"w{k}", "own", k) for k in range(4)]
    assert len([r for r in got if r[0] == "shared"]) == 1 and [v["version"] for v in publication.versions(spark, path)] == [1, 2, 3, 4]


def test_redundant_rules_among_thousands(spark):
    """Generated rules over examples with a long tail; some rules hold others whole."""
    rng = random.Random(8)
    fires = {e: {int(1500 * rng.random() ** 2) for _ in range(rng.randint(1, 25))} for e in range(1200)}
    examples: dict = {}
    for e, rules_ in fires.items():
        examples.setdefault(min(rules_), []).append(e)
        rules_ |= {r + 5000 for r in rules_ if r % 3 == 0}
    hits = [(a, e, b) for a, es in examples.items() for e in es for b in fires[e]]
    want = sorted((a, b, len(es)) for a, es in examples.items() for b in set.intersection(*(fires[e] for e in es)) - {a})
    d = spark.createDataFrame(hits + hits[:500], "example_rule int, example int, rule int")
    for prefix in (1, 3):
        assert sorted((r.rule_a, r.rule_b, r.n) for r in evaluate.redundant(d, prefix).collect()) == want
    assert len(want) > 100 and evaluate.redundant(d.where(F.lit(False))).count() == 0
