"""Vector codes and centroids against brute force in Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prosemill.llm import blocks, centroids, codes

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, q int, code string, same int"


def floor_div(a, n):
    return a // n


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def quantised(v, scale):
    return tuple(math.floor(scale * x) for x in v)


def rows_of(rng, dims, n, huge=False):
    out = []
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    hot = [0.25] * dims
    for i in range(n):
        v = hot if i % 3 == 0 else [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]
        out.append((i * 3, v, (1, 2, None)[i % 3]))
    out += [(5, None, 1), (7, [None] + [0.5] * (dims - 1), 1), (8, [float("nan")] * dims, None), (10, [float("inf")] + [0.0] * (dims - 1), 2), (11, [], 2), (13, [0.5] * (dims + 8), 2), (None, [0.125] * dims, None), (None, [-0.125] * dims, None), out[1], out[1]]
    if huge:
        out += [(1, [1e30] * dims, 2), (2, [-3e38] + [0.0] * (dims - 1), None), (4, [123456.789] * dims, 1)]
    return out


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], schema).repartition(3)


def kept(rows, dims):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]


def single(rows):
    """Components as the table holds them: four-byte floats."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


def brute_codes(rows, dims, parts=8, entries=16, rounds=6):
    data = [(i, quantised(v, 4096), y) for i, v, y in kept(rows, dims)]
    data.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step, out = dims // parts, defaultdict(list)
    numbers = []
    for p in range(parts):
        cut = [q[p * step : (p + 1) * step] for _, q, _ in data]
        book = [list(c) for c in cut[:entries]]
        near = lambda c: min(range(len(book)), key=lambda e: (far(c, book[e]), e))  # noqa: B023, E731
        for _ in range(rounds):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c)].append(c)
            for e, g in groups.items():
                book[e] = [floor_div(sum(x), len(g)) for x in zip(*g, strict=True)]
        for k, c in enumerate(cut):
            e = near(c)
            out[k].append((e, far(c, book[e])))
        numbers += [x for b in book for x in b]
    label = defaultdict(int)
    for k, (_, _, y) in enumerate(data):
        label[y] += sum(d for _, d in out[k])
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, "".join(f"{e:02x}" for e, _ in out[k]), long(sum(d for _, d in out[k])), long(label[y]), digest) for k, (i, _, y) in enumerate(data)), key=str)


def brute_clusters(rows, dims, k=40, rounds=5):
    data = [(i, quantised(v, 256)) for i, v, _ in kept(rows, dims)]
    order = sorted(data, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(q) for _, q in order[:k]]
    near = lambda q: min(range(len(centres)), key=lambda c: (far(q, centres[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in data:
            groups[near(q)].append(q)
        for c, g in groups.items():
            centres[c] = [floor_div(sum(x), len(g)) for x in zip(*g, strict=True)]
    found = [(i, near(q), far(q, centres[near(q)])) for i, q in data]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, long(d), long(inertia[c]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=str)


@pytest.mark.parametrize("huge", [False, True])
def test_vector_codes(spark, huge):
    rows = single(rows_of(random.Random(3), 16, 150, huge))
    got = codes.vector_codes(frame(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows, 16)


@pytest.mark.parametrize("huge", [False, True])
def test_centroids(spark, huge):
    rows = single(rows_of(random.Random(4), 64, 120, huge))
    got = centroids.cluster(frame(spark, rows)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows, 64)


def test_fewer_vectors_than_entries_and_centres(spark):
    rows = single([(i, [0.1 * i + 0.01 * d for d in range(64)], i % 2) for i in range(5)])
    assert sorted(map(tuple, codes.vector_codes(frame(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == brute_codes(rows, 64)
    assert sorted(map(tuple, centroids.cluster(frame(spark, rows)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str) == brute_clusters(rows, 64)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2), (2, [None] * 64, 1)]):
        assert codes.vector_codes(frame(spark, rows)).collect() == []
        assert centroids.cluster(frame(spark, rows)).collect() == []


def test_double_vectors_and_text_labels(spark):
    rows = [(i, [math.sin(i * 7 + d) for d in range(64)], None) for i in range(60)]
    d = spark.createDataFrame([(i, v, "even" if i % 2 == 0 else None) for i, v, _ in rows], "vec_id int, embedding array<double>, label string")
    got = codes.vector_codes(d).select("vec_id", "code", "error").collect()
    assert sorted(map(tuple, got)) == sorted(r[:3] for r in brute_codes(rows, 64))
    assert codes.vector_codes(d).agg(F.countDistinct("label_error")).head()[0] == 2
    assert sorted((r.vec_id, r.cluster, r.distance) for r in centroids.cluster(d).collect()) == sorted(r[:3] for r in brute_clusters(rows, 64))


def test_dealing_does_not_matter(spark):
    rows = single(rows_of(random.Random(9), 64, 90))
    one, many = frame(spark, rows).coalesce(1), frame(spark, rows).repartition(9)
    assert sorted(map(str, codes.vector_codes(one).collect())) == sorted(map(str, codes.vector_codes(many).collect()))
    assert sorted(map(str, centroids.cluster(one).collect())) == sorted(map(str, centroids.cluster(many).collect()))


def test_exact_distances():
    import numpy as np

    m, c = np.array([[3.0, -4.0], [1e20, 2.0]]), np.array([[0.0, 0.0], [1e20, 1.0]])
    best, d = blocks.nearest(*(lambda a, b: (a.T, b))(*blocks.whole(m, c)))
    assert best.tolist() == [0, 1] and d.tolist() == [25, 1]
    best, d = blocks.nearest(*(lambda a, b: (a.T, b))(*blocks.whole(m[:1], c[:1])))
    assert d.dtype == np.int64 and d.tolist() == [25]
