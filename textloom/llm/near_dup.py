"""Near-duplicate detection: MinHash with tensored banding, exact verification, connected components.

Words are lower-cased (A-Z) and parted at white space; a document's set is its distinct 5-word shingles. Documents with
equal sets form a class, found by a 128-bit digest of the set; the rest works on classes. ``HALVES`` half keys of two
minhashes each are computed, and every pair of half keys is one table key: HALVES * (HALVES - 1) / 2 tables of four
rows for 2 * HALVES minhashes. A pair at similarity 0.75 shares no table with probability 2e-4, and at 0.85 with 1e-7.

Only half keys that two classes share make table keys. In each table bucket every class is joined to one centre (the
class whose half keys are the most shared) if their signatures agree in enough places; what the centre rejects is
compared, by signature, with all others of the bucket, in blocks. So no two alike classes of a bucket are left apart,
and a bucket gives no more joins than it has classes.

Joins are confirmed on full shingle sets in two steps. First each class is compared with the one it is most like, which
settles groups of near copies in linear time, whatever their size: a centre's partners are dealt into parts. Where joins
remain between parts that this leaves unconnected, those parts form a family, and every pair of sets in different parts
of it is compared: the largest part is dealt into blocks, and each is compared with each block of the others. Confirmed
links give the components, by large-star and small-star steps. All sums are partial before shuffles; nothing of the
corpus reaches the driver, and texts are joined to few ids, which are broadcast up to a bound.

Null and empty texts have no set, are linked with nothing and stay. Rows with equal doc_id are one node: what either
links to is linked. A null doc_id is a node of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textloom.llm.common import ASCII_LOWER, mix64, pick, sized, text_slices, word_hashes
from textloom.session import Workspace, ship_package

SHINGLE, HALVES, SHARE = 5, 14, 75
#: Signature places (of 2 * HALVES) that must agree; a pair at 0.75 fails with probability 2e-5.
AGREE = 12
#: Most partners of a centre, sets of a family, or classes of a bucket that a task compares at once; and shingles of a block.
PARTNERS, BLOCK_SETS, BLOCK_CLASSES, BLOCK_SHINGLES = 64, 128, 256, 200_000
#: Rows that a task turns into objects at once.
ROWS_AT_ONCE = 256
LEAST = np.iinfo(np.int64).min
#: Odd factors: one for each place in a shingle, one for each minhash.
PLACES = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
FACTORS = mix64(np.arange(101, 101 + 2 * HALVES, dtype=np.uint64)) | np.uint64(1)
SALTS = mix64(np.arange(501, 501 + HALVES, dtype=np.uint64))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of fewer words, one of them all."""
    h = word_hashes().of(text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split())
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mix64((h * PLACES[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    return np.unique(mix64(sum(h[i : i + n] * PLACES[i] for i in range(SHINGLE))))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, halves, marks): size and digest of the set, half keys, and 32 bits of each minhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                sets = [shingles(t) for t in texts]
                n = np.array([len(s) for s in sets], np.int64)
                some = n > 0
                starts = (np.cumsum(n) - n)[some]
                every = np.concatenate(sets)
                halves, marks = np.zeros((len(n), HALVES), np.uint64), np.zeros((len(n), 2 * HALVES), np.uint64)
                sums = np.zeros((len(n), 2), np.uint64)
                if len(every):
                    for k in range(2 * HALVES):
                        marks[some, k] = np.minimum.reduceat(every * FACTORS[k], starts)
                    for k in range(2):
                        sums[some, k] = np.add.reduceat(mix64(every + SALTS[k]), starts)
                    halves = mix64(marks[:, ::2] * FACTORS[0] + marks[:, 1::2] * FACTORS[1] + SALTS)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1))) for x in (halves.view(np.int64), (marks >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(n), *(pa.array(sums[:, k].view(np.int64)) for k in (0, 1)), *lists], names=["doc_id", "n", "s1", "s2", "halves", "marks"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, halves array<long>, marks array<int>")


def candidate_joins(classes: DataFrame, work: Workspace) -> DataFrame:
    """(a, b, agree): classes to be looked at together, and places of their signatures that agree."""
    each = classes.select("rep", F.explode("halves").alias("half"))
    shared = each.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1")
    live = each.join(shared, "half").groupBy("rep").agg(F.array_sort(F.collect_set("half")).alias("h"), F.sum(F.log("c")).alias("w")).filter(F.size("h") > 1)
    pairs = F.flatten(F.transform("h", lambda x, i: F.transform(F.slice("h", i + 2, F.greatest(F.size("h") - i - 1, F.lit(0))), lambda y: F.xxhash64(x, y))))
    keys = live.select("rep", "w", F.explode(pairs).alias("t"))
    rank = F.struct("w", "rep")
    left = keys.join(keys.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "t")
    left = work.save(left.select("t", rank.alias("x")), "keys")
    marks = classes.select("rep", "n", "marks")
    one, two = (marks.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("marks").alias(f"m_{c}")) for c in "ab")
    agree = F.size(F.filter(F.zip_with("m_a", "m_b", lambda x, y: x == y), lambda e: e))
    fits = 100 * F.least("n_a", "n_b") >= SHARE * F.greatest("n_a", "n_b")

    def alike(pair: DataFrame) -> DataFrame:
        return pair.join(one, "a").join(two, "b").withColumn("agree", agree).filter(fits & (F.col("agree") >= AGREE)).select("a", "b", "agree")

    centre = left.groupBy("t").agg(F.max("x").alias("centre"), F.count("*").alias("c")).filter("c > 1").drop("c")
    met = left.join(centre, "t").filter("x < centre").select(F.col("centre.rep").alias("a"), F.col("x.rep").alias("b"), "t")
    good = work.save(alike(met.select("a", "b").distinct()), "joins0")
    rejected = work.save(met.join(good.select("a", "b"), ["a", "b"], "left_anti").select("t", F.col("b").alias("rep")).distinct(), "rejected")
    # what a centre keeps is joined through it; what it rejects meets all others of its buckets
    every = left.select("t", F.col("x.rep").alias("rep"))
    parts = lambda n: F.ceil(F.col(n) / BLOCK_CLASSES).cast("int")
    sizes = rejected.groupBy("t").agg(F.count("*").alias("r")).join(every.groupBy("t").agg(F.count("*").alias("m")), "t").select("t", parts("r").alias("ni"), parts("m").alias("nj"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rejected.join(sizes, "t").withColumn("i", own("ni")).withColumn("j", spread("nj")).select("t", "i", "j", F.lit(0).alias("side"), "rep")
    columns = every.join(sizes, "t").withColumn("j", own("nj")).withColumn("i", spread("ni")).select("t", "i", "j", F.lit(1).alias("side"), "rep")
    dealt = rows.unionByName(columns).join(marks, "rep").repartition("t", "i", "j").sortWithinPartitions("t", "i", "j", "side", "rep")
    others = work.save(bucket_joins(dealt.select("t", "i", "j", "side", "rep", "n", "marks")), "joins1")
    for name in ("keys", "rejected"):
        work.remove(name)
    return good.unionByName(others)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[list[list]]:
    """Columns of each run of rows with equal keys; the rows come sorted by them."""
    at, held = None, []
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            for row in zip(*(batch.column(c).slice(start, ROWS_AT_ONCE).to_pylist() for c in (*keys, *names)), strict=True):
                if row[: len(keys)] != at:
                    if held:
                        yield [list(c) for c in zip(*held, strict=True)]
                    at, held = row[: len(keys)], []
                held.append(row[len(keys) :])
    if held:
        yield [list(c) for c in zip(*held, strict=True)]


class Parts:
    """Parts of the nodes of one task, and the links that join them: no more than a forest."""

    def __init__(self, labels: list):
        self.part, self.links = np.unique(np.array(labels), return_inverse=True)[1], []

    def link(self, own: int, near: np.ndarray, what: list[tuple]) -> None:
        """Join own's part with those of the nodes ``near``, one link for each part."""
        others, first = np.unique(self.part[near], return_index=True)
        for part, k in zip(others.tolist(), first.tolist(), strict=True):
            if part != self.part[own]:
                self.links.append(what[k])
                self.part[self.part == part] = self.part[own]


def bucket_joins(dealt: DataFrame) -> DataFrame:
    """(a, b, agree): which rows (side 0) and columns (side 1) of a bucket's block have signatures that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, rep, n, marks in groups_of(batches, ["t", "i", "j"], ["side", "rep", "n", "marks"]):
            n, marks, rows = np.array(n), np.array(marks, np.int32), side.count(0)
            parts = Parts(rep)
            for k in range(rows):
                agree = (marks[rows:] == marks[k]).sum(axis=1)
                fits = (agree >= AGREE) & (100 * np.minimum(n[rows:], n[k]) >= SHARE * np.maximum(n[rows:], n[k]))
                near = np.flatnonzero(fits)
                parts.link(k, near + rows, [(rep[rows + j], rep[k], int(agree[j])) for j in near.tolist()])
            if parts.links:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts.links, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["a", "b", "agree"])

    return dealt.mapInArrow(run, "a long, b long, agree int")


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root): the least node of each component, for nodes that have an edge (a, b)."""
    last = f"{name}0"

    def saved(e: DataFrame, to: str) -> tuple[DataFrame, tuple]:
        """The edges as a table, and their number and a sum of their hashes, observed while they are written."""
        seen = Observation()
        e = e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        return work.save(e, to, release=False), (seen.get["n"], seen.get["h"])

    now, before = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), last)
    for step in itertools.count(1) if before[0] else ():
        for kind in ("large", "small"):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))) if kind == "large" else now
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            least = work.save(least, f"{name}-least", release=False)  # a table, so that the join on a node of many edges can be split
            met = both.join(least, "u")
            if kind == "large":  # larger neighbours to the least one
                new = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:  # smaller neighbours and the node itself to the least one
                new = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            now, after = saved(new.filter("u <> v").distinct(), f"{name}{step}{kind}")
            work.remove(last)
            last = f"{name}{step}{kind}"
        if after == before:
            break
        before = after
    work.remove(f"{name}-least")
    work.release()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def alike_sets(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets meet the contract's share."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if 100 * len(small) < SHARE * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= SHARE * (len(one) + len(two) - common)


def confirmed_pairs(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the edges (a, b) whose sets are alike; a's partners are dealt into parts, each with a's set."""
    parts = edges.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    partners = edges.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("b").alias("rep"))
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("a").alias("rep"))
    dealt = centres.unionByName(partners).join(sets, "rep").repartition("a", "part").sortWithinPartitions("a", "part", "side", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, links = None, [], []
        for batch in batches:
            for a, part, side, rep, data in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "side", "rep")), batch.column("set"), strict=True):
                if (a, part) != at:
                    at, own = (a, part), []
                x = np.frombuffer(data.as_buffer(), np.uint64)
                if side == 0:
                    own.append(x)
                elif any(alike_sets(x, c) for c in own):
                    links.append((a, rep))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])
                links = []

    return dealt.select("a", "part", "side", "rep", "set").mapInArrow(run, "a long, b long")


def family_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets in different parts of a family, from (family, part, rep, n): all that could join two parts.

    The largest part is not compared within itself: each block of the other parts meets each block of all.
    """
    parts = members.groupBy("family", "part").agg(F.count("*").alias("c"))
    body = parts.groupBy("family").agg(F.max_by("part", F.struct("c", "part")).alias("body"))
    blocks = lambda on, name: F.greatest(F.ceil(F.sum(F.when(on, F.col("n"))) / BLOCK_SHINGLES), F.ceil(F.count_if(on) / BLOCK_SETS)).cast("int").alias(name)
    told = members.join(body, "family").withColumn("rest", F.col("part") != F.col("body"))
    sizes = told.groupBy("family").agg(blocks(F.col("rest"), "ni"), blocks(F.lit(True), "nj"))
    told = told.join(sizes, "family")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = told.filter("rest").withColumn("i", own("ni")).withColumn("j", spread("nj")).select("family", "i", "j", F.lit(0).alias("side"), "part", "rep")
    columns = told.withColumn("j", own("nj")).withColumn("i", spread("ni")).select("family", "i", "j", F.lit(1).alias("side"), "part", "rep")
    dealt = rows.unionByName(columns).join(sets, "rep").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, part, rep, data in groups_of(batches, ["family", "i", "j"], ["side", "part", "rep", "set"]):
            if links := compare_sets(side.count(0), part, rep, [np.frombuffer(d, np.uint64) for d in data]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return dealt.select("family", "i", "j", "side", "part", "rep", "set").mapInArrow(run, "a long, b long")


def compare_sets(rows: int, labels: list[int], reps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all parts that a link between the first ``rows`` sets and the others joins."""
    n = np.array([len(s) for s in sets], np.int64)
    if rows in (0, len(sets)):
        return []
    ids, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(n) - n
    parts, mark = Parts(labels), np.zeros(len(ids), np.int64)
    columns = inverse[starts[rows] :]
    for k in range(rows):
        own = inverse[starts[k] : starts[k] + n[k]]
        mark[own] = 1
        common = np.add.reduceat(mark[columns], starts[rows:] - starts[rows])
        mark[own] = 0
        near = np.flatnonzero((100 * common >= SHARE * (n[rows:] + n[k] - common)) & (parts.part[rows:] != parts.part[k])) + rows
        parts.link(k, near, [(reps[k], reps[j]) for j in near.tolist()])
    return parts.links


def full_sets(wanted: DataFrame) -> DataFrame:
    """The shingle sets of (rep, text, ...) rows, as bytes, in place of the text."""
    names = [n for n in wanted.columns if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                sets = pa.array([shingles(t).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(n)[a:b] for n in names), sets], names=[*names, "set"])

    return wanted.mapInArrow(run, ", ".join(f"{n} {wanted.schema[n].dataType.simpleString()}" for n in names) + ", set binary")


def near_duplicates(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; it reads tables of ``work``."""
    spark = docs.sparkSession
    ship_package(spark)
    work = work or Workspace(spark, "near-dup")
    own = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "text")
    marked = work.save(signatures(own), "signatures")
    grouped = marked.filter("n > 0").groupBy("s1", "s2", "n")
    classes = work.save(grouped.agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"), F.first("marks").alias("marks")), "classes")
    joins = candidate_joins(classes, work)
    nodes = joins.select(F.col("a").alias("rep")).unionByName(joins.select(F.col("b").alias("rep"))).distinct()
    nodes = work.save(nodes.join(classes.groupBy("rep").agg(F.max("n").alias("n")), "rep"), "nodes", release=False)
    wanted = own.join(sized(nodes.select(F.col("rep").alias("doc_id"))), "doc_id").select(F.col("doc_id").alias("rep"), "text")
    sets = work.save(full_sets(wanted), "sets")
    # each class against the one it is most like
    nearest = joins.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).filter("a <> b")
    near = components(confirmed_pairs(nearest, sets), work, "near")
    parts = work.save(nodes.join(near.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", F.coalesce("root", "rep").alias("part")), "parts", release=False)
    # joins between parts make families, in which all parts are compared
    part_of = lambda c: parts.select(F.col("rep").alias(c), F.col("part").alias(f"p{c}"))
    met = lambda e: e.join(part_of("a"), "a").join(part_of("b"), "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    across = work.save(met(joins.select("a", "b")), "across", release=False)
    roots = parts.select(F.col("rep").alias("node"), F.col("part").alias("root"))
    if not across.isEmpty():
        families = components(across, work, "family")
        members = work.save(parts.join(families.select(F.col("node").alias("part"), F.col("root").alias("family")), "part"), "members", release=False)
        links = work.save(family_links(members, sets), "links", release=False)
        if not links.isEmpty():
            whole = components(met(links), work, "final").withColumnRenamed("node", "part")
            roots = work.save(parts.join(whole, "part", "left").select(F.col("rep").alias("node"), F.coalesce("root", "part").alias("root")), "roots", release=False)
    for name in ("joins0", "joins1", "nodes", "sets", "across", "members", "links"):
        work.remove(name)
    named = classes.select("s1", "s2", "n", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("root", "rep").alias("component"))
    # rows with equal doc_id may stand in several classes; all of them are joined by it
    out = marked.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    real = lambda c: F.when(F.col(c) != LEAST, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of the least doc_id, with the columns it came with."""
    work, own = (Workspace(docs.sparkSession, n) for n in ("near-dup-kept", "near-dup"))
    gone = work.save(near_duplicates(docs, own).filter("not kept").select("doc_id").distinct(), "gone")
    own.remove("")
    work.release()
    return docs.join(sized(gone), "doc_id", "left_anti").select(*[F.col(f"`{n}`") for n in docs.schema.names])


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - {SHINGLE - 1}, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {SHARE} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
f AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, f.root AS component_id, d.doc_id = f.root AS kept
FROM documents d JOIN f ON f.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
