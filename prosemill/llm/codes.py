"""Vector code compression: product quantisation with whole numbers, codebooks fitted by an RDD treeAggregate.

Vectors are floored to whole numbers and cut into equal consecutive parts. Blocks
of parts lie column by column in a written table; in each round every task adds
its blocks' parts up by nearest entry (distances dimension by dimension, np.add.at
into a tensor of parts x entries x components), and the tensors, a few kilobytes
whatever the input, merge through a reduction tree. All sums are exact integers,
so codes do not depend on how the rows are dealt.

Defined results: rows with a null vector, or a null or non-finite component, are
dropped, and so are vectors without components or of another length than most
(the commonest length that divides into the parts; of equally common ones the
longest), as they have no parts to compare. The codebook starts from the smallest
vec_ids, nulls last, ties by the vector; with fewer vectors than entries it has as
many entries as vectors. Repeated rows are rows of their own. An error beyond 64
bits is null. No vectors: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def _part_nearest(columns: np.ndarray, books: np.ndarray):
    """For each part: (its columns, index of the nearest entry, squared distance)."""
    step = books.shape[2]
    for p in range(len(books)):
        part, entries = blocks.whole(columns[p * step : (p + 1) * step], books[p])
        yield p, part, *blocks.nearest(part, entries)


def fit(table: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x components) after so many rounds over a table of column blocks."""
    parts, entries, step = books.shape
    rdd = table.select("data").rdd.map(lambda r: bytes(r.data))
    zero = np.zeros((parts, entries, step), np.int64), np.zeros((parts, entries), np.int64)

    for _ in range(rounds):
        now = books

        def add(total, data, now=now):
            sums, counts = total
            for p, part, best, _ in _part_nearest(blocks.unpack_column(data, parts * step), now):
                # a part's rows go to its entries: places are (part, entry), values are rows of components
                sums = blocks.add_at(sums, (np.full(len(best), p), best), np.ascontiguousarray(part.T))
                np.add.at(counts, (np.full(len(best), p), best), 1)
            return sums, counts

        sums, counts = rdd.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=2)
        used = counts > 0
        books = books.astype(sums.dtype) if sums.dtype == object else books.copy()
        books[used] = sums[used] // counts[used][:, None]
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    schema = "vec_id long, code string, error decimal(38,0)"
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"), F.col(label_col).alias("label"))
    kind = slim.schema["label"].dataType.simpleString()
    table = saved(blocks.column_blocks(slim, "vector", scale, parts), "code-blocks")
    lengths = sorted(((r.total, r.dims) for r in table.groupBy("dims").agg(F.sum("n").alias("total")).collect()), reverse=True)  # a row for each length there is
    if not lengths:
        return slim.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dims = lengths[0][1]
    rows = blocks.usable(slim, "vector").where(F.size("vector") == dims)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).toArrow()
    start = np.concatenate([m for _, m in blocks.quantised(first.column(0), scale)])
    (start,) = blocks.whole(start)
    books = start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
    books = fit(table.where(F.col("dims") == dims), books, rounds)
    digest = blocks.digest_of(books.reshape(-1))

    def assign(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, blocks.ROWS):
                piece = batch.slice(a, blocks.ROWS)
                for kept, m in blocks.quantised(piece.column(1), scale, parts):
                    if not len(kept):
                        continue
                    codes, error = np.empty((len(kept), parts), np.int64), np.zeros(len(kept), object)
                    for p, _, best, far in _part_nearest(m.T, books):
                        codes[:, p] = best
                        error = error + far
                    at = pa.array(kept)
                    texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(at), piece.column(2).take(at), pa.array(texts), pa.array([str(int(e)) for e in error])], names=["vec_id", "label", "code", "error"])

    # sums over a label may pass 64 bits before they are told to be null, and an error may pass 38 digits: then it is null too
    coded = saved(rows.mapInArrow(assign, f"vec_id long, label {kind}, code string, error string").withColumn("error", F.expr("try_cast(error as decimal(38,0))")), "codes")
    sums = coded.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.sum("error")).alias("label_error"))
    sums = saved(sums.withColumnRenamed("label", "of"), "code-labels")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", F.expr("try_cast(error as bigint)").alias("error"), F.expr("try_cast(label_error as bigint)").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dims: int = 64) -> str:
    """The same for vectors of one length, in SQL: a pair of tables a round."""
    step = dims // parts
    numbers = f"list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)"
    far = "list_sum(list_transform(range(1, {n}), lambda j: (x.v[j] - b.v[j]) * (x.v[j] - b.v[j])))::BIGINT".format(n=step + 1)
    ctes = [
        f"kept AS (SELECT vec_id, label, {numbers} AS q FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS (SELECT vec_id, label, p.p, kept.q[p.p * {step} + 1 : (p.p + 1) * {step}] AS v FROM kept, range({parts}) AS p(p))",
        f"book0 AS (SELECT p, rank - 1 AS e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id, v) AS rank FROM parts) WHERE rank <= {entries})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"near{r} AS (SELECT x.vec_id, x.p, any_value(x.label) AS label, any_value(x.v) AS v, min({{'d': {far}, 'e': b.e}}) AS best FROM parts x JOIN book{r} b USING (p) GROUP BY x.vec_id, x.p)")
        if r < rounds:
            ctes.append(f"sums{r} AS (SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT p, best.e AS e, unnest(range(1, {step + 1})) AS i, unnest(v) AS c FROM near{r}) GROUP BY p, e, i)")
            ctes.append(f"mean{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM sums{r} GROUP BY p, e)")
            ctes.append(f"book{r + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m USING (p, e))")
    ctes.append(f"final AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS d FROM book{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT d FROM digest) AS codebooks_sha256 FROM final"


SQL = _sql()
