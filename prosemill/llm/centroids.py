"""Centroid clustering with weighted deduplication: Lloyd's rounds over different vectors alone.

Vectors are floored to whole numbers; identical ones become one with its
multiplicity, however many rows share it. A round assigns each different vector
once and adds it up with its weight in exact integers; the sums (centres x
components) merge through a reduction tree. Assignments go back to vec_ids by a
join on the vector's SHA-256, both sides of which are written tables, so a vector
that a third of all rows share is split.

Defined results: only vectors of the given length without null or non-finite
components take part. Starting centres are the vectors whose ids hash lowest,
ties by the vector, null ids last; with fewer vectors than centres there are as
many centres as vectors. Equal vectors may start several centres: all go to the
one with the smallest number. Repeated rows are rows of their own. Distances and
sums beyond 64 bits are null. No vectors: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import saved

CENTRES, ROUNDS, SCALE, DIMS, SEED = 40, 5, 256, 64, 2
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised_rows(vectors: DataFrame, scale: int, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, q): kept vectors as the bytes of their whole numbers, held as doubles."""

    def pack(batches):
        for batch in batches:
            for kept, m in blocks.quantised(batch.column(1), scale):
                if len(kept):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array([row.tobytes() for row in m.astype("<f8")], pa.binary())], names=["vec_id", "q"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"))
    return blocks.usable(rows, "vector").where(F.size("vector") == dims).mapInArrow(pack, "vec_id long, q binary")


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dims)


def weighted_blocks(distinct: DataFrame, dims: int) -> DataFrame:
    """(data, weights): columnar blocks of different vectors with their multiplicities."""

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, blocks.ROWS):
                piece = batch.slice(a, blocks.ROWS)
                yield pa.RecordBatch.from_pydict({"data": pa.array([blocks.pack_column(_matrix(piece.column(0), dims))], pa.binary()), "weights": pa.array([piece.column(1).to_numpy().astype("<i8").tobytes()], pa.binary())})

    return distinct.select("q", "weight").mapInArrow(pack, "data binary, weights binary")


def lloyd(table: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after so many rounds over a table of weighted blocks."""
    k, dims = centres.shape
    rdd = table.select("data", "weights").rdd.map(lambda r: (bytes(r.data), bytes(r.weights)))
    for _ in range(rounds):
        now = centres

        def add(total, block, now=now):
            sums, counts = total
            columns, c = blocks.whole(blocks.unpack_column(block[0], dims), now)
            weights = np.frombuffer(block[1], "<i8")
            best, _ = blocks.nearest(columns, c)
            np.add.at(counts, best, weights)
            return blocks.add_at(sums, best, columns.T * weights[:, None]), counts

        zero = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        sums, counts = rdd.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=2)
        used = counts > 0
        centres = centres.astype(sums.dtype) if sums.dtype == object else centres.copy()
        centres[used] = sums[used] // counts[used][:, None]
    return centres


def cluster(vectors: DataFrame, k: int = CENTRES, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    rows = saved(quantised_rows(vectors, scale, dims, id_col, vec_col), "centroid-rows")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").toArrow()
    if not first.num_rows:
        return spark.createDataFrame([], OUT)
    distinct = saved(rows.groupBy("q").agg(F.count("*").alias("weight")), "centroid-distinct")
    table = saved(weighted_blocks(distinct, dims), "centroid-blocks")
    (start,) = blocks.whole(_matrix(first.column(0), dims))
    centres = lloyd(table, start, rounds)

    def assign(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, blocks.ROWS):
                piece = batch.slice(a, blocks.ROWS)
                best, far = blocks.nearest(*blocks.whole(_matrix(piece.column(0), dims).T, centres))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(best, pa.int32()), pa.array([str(int(x)) for x in far])], names=["q", "weight", "cluster", "distance"])

    near = distinct.mapInArrow(assign, "q binary, weight long, cluster int, distance string").withColumn("distance", F.expr("try_cast(distance as decimal(38,0))"))
    near = saved(near.select(F.unhex(F.sha2("q", 256)).alias("of"), "weight", "cluster", "distance"), "centroid-near")
    # exact sums: distances go in two halves of ten digits and more, which a weight cannot push past 38 digits
    half = F.lit(10**10).cast("decimal(11,0)")
    low = (F.col("distance") % half).cast("decimal(11,0)")
    high = ((F.col("distance") - low) / half).cast("decimal(28,0)")
    weight = F.col("weight").cast("decimal(20,0)")
    per = near.groupBy("cluster").agg(F.count("*").alias("all"), F.count("distance").alias("known"), F.sum((low * weight).cast("decimal(38,0)")).alias("low"), F.sum((high * F.col("weight").cast("decimal(10,0)")).cast("decimal(38,0)")).alias("high")).collect()  # a row a centre
    inertia = {r.cluster: int(r.low) + int(r.high) * 10**10 if r["all"] == r.known else None for r in per}
    total = None if None in inertia.values() else sum(inertia.values())
    long = lambda x: None if x is None else blocks.as_long(x)
    told = spark.createDataFrame([(c, long(inertia[c]), long(total), blocks.digest_of(centres[c])) for c in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = rows.select("vec_id", F.unhex(F.sha2("q", 256)).alias("of")).join(near.select("of", "cluster", F.expr("try_cast(distance as bigint)").alias("distance")), "of")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql(k: int = CENTRES, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED) -> str:
    """The same in SQL: different vectors with weights, a pair of tables a round."""
    far = f"list_sum(list_transform(range(1, {dims + 1}), lambda j: (x.q[j] - b.q[j]) * (x.q[j] - b.q[j])))::BIGINT"
    ctes = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "distinct_rows AS (SELECT q, count(*) AS weight FROM kept GROUP BY q)",
        f"centre0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM kept ORDER BY h, q LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"near{r} AS (SELECT x.q, any_value(x.weight) AS weight, min({{'d': {far}, 'c': b.c}}) AS best FROM distinct_rows x CROSS JOIN centre{r} b GROUP BY x.q)")
        if r < rounds:
            ctes.append(f"sums{r} AS (SELECT c, i, sum(v * weight)::BIGINT AS s, sum(weight)::BIGINT AS n FROM (SELECT best.c AS c, weight, unnest(range(1, {dims + 1})) AS i, unnest(q) AS v FROM near{r}) GROUP BY c, i)")
            ctes.append(f"mean{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM sums{r} GROUP BY c)")
            ctes.append(f"centre{r + 1} AS (SELECT b.c, coalesce(m.q, b.q) AS q FROM centre{r} b LEFT JOIN mean{r} m USING (c))")
    last = f"near{rounds}"
    ctes.append(f"inertias AS (SELECT best.c AS c, sum(best.d * weight)::BIGINT AS cluster_inertia FROM {last} GROUP BY 1)")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM inertias) AS inertia, sha256(array_to_string(e.q, ',')) AS centroid_sha256
FROM kept JOIN {last} n USING (q) JOIN inertias i ON i.c = best.c JOIN centre{rounds} e ON e.c = best.c"""


SQL = _sql()
