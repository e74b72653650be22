"""Quality classifier by co-training two views: text content, and page metadata.

The text view sees hashed character trigrams, the metadata view source, language and length. Both are logistic models
fitted on the driver on at most ``LABELLED`` labelled documents (the first by hash of their id), a fifth of them held
out. In each of ``ROUNDS`` rounds all unlabelled documents of the corpus are scored by executors, and a view hands the
other the ``HAND_OVER`` documents it is surest of, in the proportion of the labels. It does so only for a kind of label
for which, on the held-out documents it is surest of, it is right more often than the other view is: a weak view would
only add noise to a strong one. Each view's margins are calibrated on the held-out fifth, and a logistic model combines
them there. The models of before the rounds are kept unless the rounds lower the combination's log loss on the held-out
fifth by more than its standard error.
All documents are then scored in one pass without a shuffle, with weights of fixed size.

Null text is empty, null metadata is a value of its own. Rows with equal doc_id are each scored; of several labels of
one doc_id the largest counts. Without labels of both kinds every score is the share of good ones (one half if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import pick, text_slices
from textloom.llm.quality_rules import trigram_buckets
from textloom.session import Workspace, ship_package

LABELLED, ROUNDS, HAND_OVER = 3000, 4, 300
#: Share of the held-out documents of a predicted kind that count as those a view is surest of.
SUREST = 0.25
TEXT_SLOTS, META_SLOTS, STEPS, MORE_STEPS, RIDGE = 1 << 14, 1 << 12, 80, 30, 1e-4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]  # slots, values, number of them in each row


def text_view(texts: list[str]) -> Sparse:
    """Square roots of trigram shares, so each row has length one."""
    slots, values, n = [], [], []
    for t in texts:
        k, c = np.unique(trigram_buckets(t) % TEXT_SLOTS, return_counts=True)
        slots.append(k)
        values.append(np.sqrt(c / c.sum()) if len(c) else np.zeros(0))
        n.append(len(k))
    return np.concatenate(slots), np.concatenate(values), np.array(n)


def meta_view(lang: list, source: list, n_chars: list) -> Sparse:
    import xxhash

    slots = []
    for a, b, c in zip(lang, source, n_chars, strict=True):
        size = -1 if c is None else int(np.log2(max(c, 0) + 1) * 2)
        slots += [xxhash.xxh32_intdigest(repr(x)) % META_SLOTS for x in (("lang", a), ("source", b), ("size", size), ("lang", a, "size", size))]
    return np.array(slots, np.int64), np.ones(len(slots)), np.full(len(lang), 4)


class Logistic:
    def __init__(self, slots: int):
        self.w, self.b = np.zeros(slots), 0.0

    def margin(self, x: Sparse) -> np.ndarray:
        slots, values, n = x
        row = np.repeat(np.arange(len(n)), n)
        return np.bincount(row, self.w[slots] * values, minlength=len(n)) + self.b

    def fit(self, x: Sparse, y: np.ndarray, steps: int) -> None:
        """Full-batch Adam; both classes weigh the same."""
        slots, values, n = x
        row = np.repeat(np.arange(len(n)), n)
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))
            g = (p - y) * weight
            grad = np.append(np.bincount(slots, g[row] * values, minlength=len(self.w)) + RIDGE * self.w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w -= step[:-1]
            self.b -= step[-1]


def rows_of(x: Sparse, chosen: np.ndarray) -> Sparse:
    """The rows ``chosen``, which are in order."""
    slots, values, n = x
    wanted = np.zeros(len(n), bool)
    wanted[chosen] = True
    keep = np.repeat(wanted, n)
    return slots[keep], values[keep], n[chosen]


def joined(a: Sparse, b: Sparse) -> Sparse:
    return tuple(np.concatenate(c) for c in zip(a, b, strict=True))


def sigmoid(u: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(u, -30, 30)))


def newton(features: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of a logistic model, drawn to ``start`` by a small ridge."""
    weights = start.copy()
    for _ in range(50):
        p = sigmoid(features @ weights)
        h = (features * (p * (1 - p))[:, None]).T @ features + 0.05 * np.eye(len(start))
        weights = weights - np.linalg.solve(h, features.T @ (p - t) + 0.05 * (weights - start))
    return weights


class CoTrained:
    """Two views, slope and intercept that calibrate each, and the weights of the calibrated margins."""

    def __init__(self, text: Logistic, meta: Logistic, scale: np.ndarray, combine: np.ndarray):
        self.text, self.meta, self.scale, self.combine = text, meta, scale, combine

    def scores(self, x: Sparse, z: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.scale[0, 0] * self.text.margin(x) + self.scale[0, 1], self.scale[1, 0] * self.meta.margin(z) + self.scale[1, 1]
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


def finished(text: Logistic, meta: Logistic, x: Sparse, z: Sparse, y: np.ndarray) -> tuple[CoTrained, np.ndarray]:
    """Calibration and combination on held-out rows, and the log loss of each."""
    one = np.ones(len(y))
    scale = np.stack([newton(np.stack([m, one], axis=1), y, np.array([1.0, 0.0])) for m in (text.margin(x), meta.margin(z))])
    a, b = scale[0, 0] * text.margin(x) + scale[0, 1], scale[1, 0] * meta.margin(z) + scale[1, 1]
    model = CoTrained(text, meta, scale, newton(np.stack([a, b, one], axis=1), y, np.array([1.0, 0.0, 0.0])))
    p = np.clip(model.scores(x, z)[2], 1e-9, 1 - 1e-9)
    return model, -(y * np.log(p) + (1 - y) * np.log(1 - p))


def knows_better(giver: np.ndarray, taker: np.ndarray, y: np.ndarray, kind: int) -> bool:
    """Whether, on the held-out rows that the giver is surest are of this kind, it is right more often than the taker."""
    sign = 1 if kind else -1
    own = np.flatnonzero(sign * giver > 0)
    surest = own[np.argsort(-sign * giver[own], kind="stable")[: max(1, int(len(own) * SUREST))]]
    return bool(len(own)) and (y[surest] == kind).sum() > ((taker[surest] > 0) == y[surest]).sum()


def copy(view: Logistic) -> Logistic:
    out = Logistic(len(view.w))
    out.w, out.b = view.w.copy(), view.b
    return out


def train(x: Sparse, z: Sparse, y: np.ndarray, ask: Asked | None = None, rounds: int = ROUNDS) -> CoTrained:
    """Fit on labelled rows; every fifth is held out. ``ask`` gives rows of the corpus that a view is surest of."""
    text, meta = Logistic(TEXT_SLOTS), Logistic(META_SLOTS)
    share = y.mean() if len(y) else 0.5
    if len(np.unique(y)) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return CoTrained(text, meta, np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([0.0, 0.0, np.log(share / (1 - share))]))
    every = np.arange(len(y))
    held, base = every[::5], np.delete(every, every[::5])
    test = rows_of(x, held), rows_of(z, held), y[held].astype(float)
    data, labels = [rows_of(x, base), rows_of(z, base)], [y[base].astype(float), y[base].astype(float)]
    text.fit(data[0], labels[0], STEPS)
    meta.fit(data[1], labels[1], STEPS)
    before = finished(copy(text), copy(meta), *test)
    for _ in range(rounds if ask else 0):
        margins, taken = (text.margin(test[0]), meta.margin(test[1])), False
        wants = [(giver, kind) for giver in (0, 1) for kind in (0, 1) if knows_better(margins[giver], margins[1 - giver], y[held], kind)]
        if not wants:
            break
        counts = [max(1, round(HAND_OVER * (share if kind else 1 - share))) for _, kind in wants]
        for (giver, kind), rows in zip(wants, ask(text, meta, wants, counts), strict=True):
            if len(rows[1 - giver][2]):
                data[1 - giver] = joined(data[1 - giver], rows[1 - giver])
                labels[1 - giver] = np.append(labels[1 - giver], np.full(len(rows[1 - giver][2]), float(kind)))
                taken = True
        if not taken:
            break
        for k, view in enumerate((text, meta)):
            if any(giver != k for giver, _ in wants):
                view.fit(data[k], labels[k], MORE_STEPS)
    after = finished(text, meta, *test)
    gain = before[1] - after[1]
    return (after if gain.mean() > gain.std() / np.sqrt(len(gain)) else before)[0]


def views(batch: pa.RecordBatch, a: int, b: int, texts: list[str]) -> tuple[Sparse, Sparse]:
    return text_view(texts), meta_view(*(batch.column(n)[a:b].to_pylist() for n in ("lang", "source", "n_chars")))


def sparse_rows(docs: DataFrame, ids: DataFrame) -> pa.Table:
    """Both views of the documents with one of a bounded number of ids, one row for each id, in order of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                x, z = views(batch, a, b, texts)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v)) for n, v in ((x[2], x[0].astype(np.int32)), (x[2], x[1].astype(np.float32)), (z[2], z[0].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("y")[a:b].cast(pa.int32()), *lists], names=["doc_id", "y", "slots", "values", "meta"])

    own = pick(docs, *COLUMNS).join(F.broadcast(ids), "doc_id")
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).filter("nth = 1").drop("nth")
    rows = first.mapInArrow(run, "doc_id long, y int, slots array<int>, values array<float>, meta array<int>").toArrow()
    return rows.sort_by([("doc_id", "ascending")]).combine_chunks()


def sparse_of(rows: pa.Table) -> tuple[Sparse, Sparse, np.ndarray]:
    flat = lambda c: pc.list_flatten(rows.column(c)).to_numpy()
    count = pc.list_value_length(rows.column("slots")).to_numpy().astype(np.int64)
    meta = flat("meta")
    return (flat("slots").astype(np.int64), flat("values").astype(np.float64), count), (meta.astype(np.int64), np.ones(len(meta)), np.full(rows.num_rows, 4)), rows.column("y").to_numpy()


class Asked:
    """Rows of the unlabelled corpus that a view is surest of. Margins are made anew for a view that has changed."""

    def __init__(self, docs: DataFrame, known: DataFrame, work: Workspace):
        self.docs, self.known, self.work = pick(docs, *COLUMNS), known, work
        self.given: tuple[list[int], list[int]] = [], []  # ids that each view has been given
        self.seen: tuple[bytes, bytes] | None = None
        self.passes = 0

    def __call__(self, text: Logistic, meta: Logistic, wants: list[tuple[int, int]], counts: list[int]) -> list[tuple[Sparse, Sparse]]:
        givers = {giver for giver, _ in wants}
        state = tuple(v.w.tobytes() if k in givers else b"" for k, v in enumerate((text, meta)))
        if state != self.seen:
            self._score(text if 0 in givers else None, meta if 1 in givers else None)
            self.seen = state
        out = []
        for (giver, kind), count in zip(wants, counts, strict=True):
            m = F.col("ab"[giver]) * (1 if kind else -1)
            own = self.docs.sparkSession.createDataFrame([(i,) for i in self.given[1 - giver]], "doc_id long")
            free = self.margins.filter(m > 0).join(F.broadcast(own), "doc_id", "left_anti")  # at most ROUNDS * HAND_OVER ids
            ids = [r[0] for r in free.groupBy("doc_id").agg(F.max(m).alias("m")).orderBy(F.desc("m"), "doc_id").limit(count).collect()]
            self.given[1 - giver].extend(ids)
            x, z, _ = sparse_of(sparse_rows(self.docs, self.docs.sparkSession.createDataFrame([(i, kind) for i in ids], "doc_id long, y int")))
            out.append((x, z))
        return out

    def _score(self, text: Logistic | None, meta: Logistic | None) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, texts in text_slices(batch.column("text")):
                    none = np.zeros(b - a)
                    x = text.margin(text_view(texts)) if text else none
                    z = meta.margin(meta_view(*(batch.column(n)[a:b].to_pylist() for n in ("lang", "source", "n_chars")))) if meta else none
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(x), pa.array(z)], names=["doc_id", "a", "b"])

        self.passes += 1
        scored = self.docs.filter("doc_id is not null").mapInArrow(run, "doc_id long, a double, b double")
        self.margins = self.work.save(scored.join(self.known, "doc_id", "left_anti"), f"margins{self.passes}")


def fit_on(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """Fit on the bounded sample of labelled documents; the rounds draw on all others. Views are made by executors."""
    spark = docs.sparkSession
    ship_package(spark)
    work = Workspace(spark, "cotrain")
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    own = pick(docs, "doc_id").filter("doc_id is not null").distinct()
    some = known.join(own, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = sparse_rows(docs, some)
    if not rows.num_rows:
        none = np.zeros(0, np.int64)
        return train((none, none, none), (none, none, none), np.zeros(0))
    model = train(*sparse_of(rows), Asked(docs, known.select("doc_id"), work), rounds)
    work.remove("")
    return model


def classify(docs: DataFrame, labels: DataFrame, model: CoTrained | None = None) -> DataFrame:
    """(doc_id, text_score, meta_score, score, good) of each row: both views, and the calibrated combination."""
    model = model or fit_on(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                scores = [np.round(s, 6) for s in model.scores(*views(batch, a, b, texts))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *map(pa.array, scores), pa.array(scores[2] >= 0.5)], names=["doc_id", "text_score", "meta_score", "score", "good"])

    return pick(docs, *COLUMNS).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, good boolean")
