"""Nearest neighbours by largest inner product, through cross-polytope hashing.

Vectors are scaled by the largest norm and given one more coordinate that makes them unit vectors (queries get zero
there), so that nearness by inner product is nearness by angle. A pseudo-rotation is three rounds of random signs and
a fast Hadamard transform over all coordinates; a vector's hash is the signed axis it then lies closest to, one of two
for each coordinate. There are ``TABLES`` tables, each with a rotation of its own. A query probes the buckets of every
table in the order of its nearness to their axes, and what a table finds is weighed by that nearness, so a vector's
weight is the sum over the tables. The candidates are the vectors of greatest weight, and only they are scored, each
once, exactly and in double precision on the original vectors.

How great a weight has to be is settled by two bounded samples. On at most ``SAMPLE`` queries, whose exact neighbours
are found over all rows, the share of rows that has to be let through so that ``RECALL`` of them are; then for each
query, the weight that this share of at most ``ROWS_SAMPLE`` vectors reaches.

Queries go to the vectors in blocks of bounded size, one pass over the vectors for each; no vector is shuffled for the
search, and a task gives no more than a query's nearest of its own rows. So neither a common vector nor a full bucket
makes a task larger. Equal vectors are one entry with its 21 smallest ids, which are all that any answer can hold.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Shorter vectors count
as if filled up with zeros. Repeated rows count once. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from textloom.llm.common import pick
from textloom.session import Workspace, ship_package

NEAREST, TABLES, SAMPLE, ROWS_SAMPLE, RECALL = 20, 24, 64, 4096, 0.97
#: Bytes of queries that one pass takes, queries a task looks up at once, and rows it looks at together.
PASS_BYTES, QUERIES_AT_ONCE, ROWS_AT_ONCE = 16 << 20, 128, 10_240
SEED = 20240817


class Hasher:
    """Cross-polytope hashes of vectors of length d: of each table, an axis and its sign."""

    def __init__(self, d: int, largest: float):
        self.d, self.largest = d, largest
        self.size = 1 << d.bit_length()  # room for one more coordinate
        self.signs = np.random.default_rng(SEED).choice(np.float32([-1, 1]), (TABLES, 3, self.size))

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.size), np.float32)
        norm = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        out[:, : self.d] = x / (norm if query else self.largest)
        if not query:
            out[:, self.d] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.largest) ** 2))
        return out

    def rotate(self, u: np.ndarray, t: int) -> np.ndarray:
        """Signs and Hadamard transform, three times."""
        for signs in self.signs[t]:
            u = u * signs
            h = 1
            while h < self.size:
                v = u.reshape(len(u), -1, 2, h)
                u = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(len(u), -1)
                h *= 2
            u = u / np.float32(np.sqrt(self.size))
        return u

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """By table and vector: twice its axis, and one more if it lies on the negative side."""
        u, out = self.unit(x, False), np.zeros((TABLES, len(x)), np.int32)
        for t in range(TABLES):
            y = self.rotate(u, t)
            at = np.abs(y).argmax(axis=1)
            out[t] = 2 * at + (y[np.arange(len(y)), at] < 0)
        return out

    def probes(self, x: np.ndarray) -> np.ndarray:
        """By table, query and bucket: how near the query is to the bucket's signed axis."""
        u = self.unit(x, True)
        return np.stack([np.stack([y, -y], axis=2).reshape(len(x), -1) for y in (self.rotate(u, t) for t in range(TABLES))])


def weights(probes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """By query and vector: the nearness of the vector's buckets, over all tables."""
    out = probes[0].take(buckets[0], axis=1)
    for t in range(1, TABLES):
        out += probes[t].take(buckets[t], axis=1)
    return out


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed the same way wherever the pair is met."""
    return (q.astype(np.float64) * x.astype(np.float64)).sum(axis=1)


def best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, above: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors x, each query's ``keep`` nearest that are not below its bound: query rows, ids, exact scores."""
    score = q.astype(np.float64) @ x.astype(np.float64).T
    k = min(keep + 3, score.shape[1])  # some more, as the product's rounding may swap near ties
    low = np.maximum(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k], above - 1e-9)
    row, col = np.nonzero(score >= low[:, None] - 1e-12)
    value = exact(q[row], x[col])
    order = np.lexsort((ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    good = (place < keep) & (value >= above[row])
    return row[good], ids[col[good]], value[good]


class Top:
    """The nearest that each query has met so far."""

    def __init__(self, queries: int, keep: int):
        self.score, self.id = np.full((queries, keep), -np.inf), np.full((queries, keep), np.iinfo(np.int64).max)

    def add(self, first: int, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Pairs of the queries from ``first`` on, in order of ``row``."""
        if not len(row):
            return
        there, keep = np.unique(row), self.score.shape[1]
        n = np.bincount(row)[there]
        width = int(n.max())
        new, new_id = np.full((len(there), width), -np.inf), np.full((len(there), width), np.iinfo(np.int64).max)
        at = (np.repeat(np.arange(len(there)), n), np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        new[at], new_id[at] = score, ids
        new, new_id = np.hstack([self.score[first + there], new]), np.hstack([self.id[first + there], new_id])
        order = np.lexsort((new_id, -new))[:, :keep]
        self.score[first + there], self.id[first + there] = np.take_along_axis(new, order, axis=1), np.take_along_axis(new_id, order, axis=1)


def entries(vectors: DataFrame, query: str, work: Workspace) -> tuple[DataFrame, DataFrame, int]:
    """Distinct usable vectors (cid, embedding, ids, asked), the queries (query_id, cid), and the length of all vectors."""
    own = pick(vectors, "vec_id", "embedding")
    kind = "array<float>" if isinstance(own.schema["embedding"].dataType.elementType, FloatType) else "array<double>"
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = own.withColumn("embedding", e.cast(kind)).filter(F.col("vec_id").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0))
    d = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    fill = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(d) - F.size("embedding"))).cast(kind)
    rows = rows.withColumn("embedding", F.concat("embedding", fill)).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding"), "asked": F.coalesce(F.expr(query), F.lit(False))})
    # classes by a digest of 128 bits, so that no vector is shuffled to find them
    key = ["k1", "k2"]
    ids = work.save(rows.select(*key, "vec_id", "asked").distinct(), "ids")
    every = ids.groupBy(*key).agg(F.min("vec_id").alias("cid"), F.max("asked").alias("asked"))
    few = ids.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).filter(F.col("place") <= NEAREST + 1)
    named = work.save(every.join(few.groupBy(*key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), key), "named")
    queries = ids.filter("asked").join(named.filter("asked").select(*key, "cid"), key).select(F.col("vec_id").alias("query_id"), "cid")
    first = named.select(*key, F.col("cid").alias("vec_id"), F.lit(True).alias("first"))
    classes = rows.join(first, [*key, "vec_id"]).dropDuplicates([*key, "vec_id"]).join(named.drop("asked"), key).select("cid", "embedding", "ids", "asked")
    return classes, queries, d


def share_needed(classes: DataFrame, hasher: Hasher, sample: np.ndarray) -> float:
    """Share of the rows, by weight, that holds RECALL of the exact neighbours of the sample's queries."""
    rows = classes.filter("asked").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("cid", "embedding").collect()
    own, q = np.array([r["cid"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    if not len(rows):
        return 1.0
    d, kind = hasher.d, classes.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, ids = matrix(batch.column("embedding"), d), np.arange(batch.num_rows)
                row, at, value = best(q, ids, x, np.full(len(q), -np.inf), NEAREST + 1)
                yield pa.RecordBatch.from_arrays([pa.array(row), batch.column("cid").take(pa.array(at)), pa.array(value), batch.column("embedding").take(pa.array(at))], names=["q", "cid", "score", "embedding"])

    found = classes.select("cid", "embedding").mapInArrow(run, f"q long, cid long, score double, embedding {kind}")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    near = [r for r in found.withColumn("place", place).filter(F.col("place") <= NEAREST + 1).collect() if own[r["q"]] != r["cid"]]
    if not near:
        return 1.0
    probes = hasher.probes(q)
    at, x = np.array([r["q"] for r in near]), np.array([r["embedding"] for r in near])
    weight = weights(probes, hasher.buckets(x))[at, np.arange(len(near))]
    others = np.sort(weights(probes, hasher.buckets(sample)), axis=1)
    passed = np.array([len(sample) - np.searchsorted(others[q], w) + 1 for q, w in zip(at, weight, strict=True)]) / len(sample)
    return float(min(1.0, np.quantile(passed, RECALL, method="higher")))


def search(classes: DataFrame, ids: np.ndarray, q: np.ndarray, hasher: Hasher, sample: np.ndarray, share: float) -> DataFrame:
    """(q, cid, score) for a block of queries: of each partition's candidates, the nearest of each query."""
    d, inside = hasher.d, hasher.buckets(sample)
    rank = max(0, len(sample) - int(np.ceil(share * len(sample))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, least = Top(len(q), NEAREST + 1), {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                x, cid = matrix(part.column("embedding"), d), part.column("cid").to_numpy()
                buckets, wide = hasher.buckets(x), x.astype(np.float64)
                for s in range(0, len(q), QUERIES_AT_ONCE):
                    own = q[s : s + QUERIES_AT_ONCE]
                    near = hasher.probes(own)
                    if s not in least:
                        at = np.partition(weights(near, inside), rank, axis=1)[:, rank] if rank else np.full(len(own), -np.inf)
                        least[s] = at[:, None]
                    row, col = np.nonzero(weights(near, buckets) >= least[s])
                    for a in range(0, len(row), 1 << 17):
                        r, c = row[a : a + (1 << 17)], col[a : a + (1 << 17)]
                        value = exact(own[r], wide[c])
                        good = value >= top.score[s + r, -1]
                        top.add(s, r[good], cid[c[good]], value[good])
        row, at = np.nonzero(top.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(top.id[row, at]), pa.array(top.score[row, at])], names=["q", "cid", "score"])

    return classes.select("cid", "embedding").mapInArrow(run, "q long, cid long, score double")


def nearest_neighbours(vectors: DataFrame, query: str = "vec_id % 20 = 0", work: Workspace | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the NEAREST found for each row that ``query`` picks, its own id left out."""
    spark = vectors.sparkSession
    ship_package(spark)
    work = work or Workspace(spark, "ann")
    classes, queries, d = entries(vectors, query, work)
    classes, queries = work.save(classes, "classes"), work.save(queries, "queries")
    for name in ("ids", "named"):
        work.remove(name)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, largest = classes.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hasher = Hasher(d, largest)
    sample = np.array([r["embedding"] for r in classes.orderBy(F.xxhash64("cid", F.lit(2)), "cid").limit(ROWS_SAMPLE).select("embedding").collect()])
    share = share_needed(classes, hasher, sample)
    asked = classes.filter("asked").select("cid", "embedding")
    blocks = max(1, -(-asked.count() * 8 * d // PASS_BYTES))
    found = None
    for k in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == k).toPandas()
        if len(own):
            some = search(classes, own["cid"].to_numpy(np.int64), np.array(own["embedding"].tolist(), np.float64), hasher, sample, share)
            some = work.save(top(some, NEAREST + 1).select("q", "cid", "score"), f"found{k}")
            found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    spread = found.join(classes.select("cid", F.explode("ids").alias("vec_id")), "cid").join(queries.withColumnRenamed("cid", "q"), "q").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spread.withColumn("rank", rank).filter(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    return found.withColumn("place", place).filter(F.col("place") <= k)
