"""Substring deduplication by hashing units: of equal units the earliest stays, the rest go.

A unit is a line of at least ``line_words`` words (1 unless another floor is given), or any ``WINDOW`` words in a row:
passages that recur inside lines have no line of their own, so lines alone would miss them. Lines of ``WINDOW`` words
and more are made of windows, which find them. Units are normalised (A-Z to a-z, white space
between words left out), digested to 96 bits and grouped over the whole corpus; the occurrence of the least
(doc_id, place) is kept. A later line is removed. A later window is removed if its first occurrence is in another
document, or in the same one and does not overlap it. Removed units that touch make one span of the original text.

Not every window is shuffled. Each window is known by the least hash of the ``GRAM``-word sequences in it, which equal
windows share; these anchors are few (a twentieth of the words). Only windows whose anchor, and lines whose hash, occurs
in two texts or twice in one are digested and grouped. Exact copies of a text are found by its digest first, so groups
of copies cost one text. Counting is partial before each shuffle, and joins on hot keys can be split.

Null and empty texts hold no units. Rows with equal doc_id count as one document. A null doc_id ranks first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ASCII_LOWER, free_name, mix64, pick, text_slices, word_hashes
from textloom.session import Workspace, ship_package

#: Words of a window, least words of a line by default, and words of a sequence that can be an anchor.
WINDOW, LINE_WORDS, GRAM = 50, 1, 12
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd multipliers of the two polynomial hashes, and what sets lines apart from windows.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LINE_SALT = np.uint64(0xA0761D6478BD642F)
LEAST = np.iinfo(np.int64).min


class Powers:
    """Powers of the bases and of their inverses modulo 2**64, as far as any text asked for."""

    def __init__(self):
        self.size = 0

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            self.tables = []
            for base in BASES:
                steps = [np.full(self.size, np.uint64(x)) for x in (base, pow(base, -1, 1 << 64))]
                for s in steps:
                    s[0] = 1
                self.tables.append(tuple(np.cumprod(s, dtype=np.uint64) for s in steps))
        return self.tables


_powers = Powers()


class Text:
    """Hashes of a text's words, of any run of them in constant time, and its lines."""

    def __init__(self, text: str, line_words: int = LINE_WORDS):
        raw = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER)
        self.hashes = word_hashes().of(raw.split())
        self.n = len(self.hashes)
        self.tables = _powers.upto(self.n + 1)
        self.sums = []
        counts = np.array([len(x.split()) for x in raw.split(b"\n")], np.int64)
        starts = np.cumsum(counts) - counts
        some = (counts >= max(1, line_words)) & (counts < WINDOW)
        self.line_start, self.line_words = starts[some], counts[some]

    def run(self, start: np.ndarray, words: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Hash of the runs of ``words`` words that begin at ``start``."""
        while len(self.sums) <= which:
            h = self.hashes if not self.sums else mix64(self.hashes ^ np.uint64(BASES[0]))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.tables[len(self.sums)][0][: self.n], dtype=np.uint64)]))
        p = self.sums[which]
        return mix64((p[start + words] - p[start]) * self.tables[which][1][start])

    def window_keys(self) -> np.ndarray:
        """The anchor of each window: the least hash of the sequences in it."""
        if self.n < WINDOW:
            return np.zeros(0, np.uint64)
        a, w = self.run(np.arange(self.n - GRAM + 1), GRAM), WINDOW - GRAM + 1
        m = -(-len(a) // w) * w
        block = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
        block[: len(a)] = a
        block = block.reshape(-1, w)
        ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        count = len(a) - w + 1
        return np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])

    def line_keys(self) -> np.ndarray:
        return self.run(self.line_start, self.line_words) ^ LINE_SALT

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the text's units, and whether each may stand for two units here."""
        out, again = [], []
        each = self.window_keys()
        if len(each):
            edge = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
            length = np.diff(np.append(edge, len(each)))
            value, at, runs = np.unique(each[edge], return_inverse=True, return_counts=True)
            longest = np.zeros(len(value), np.int64)
            np.maximum.at(longest, at, length)
            out.append(value)
            again.append((runs > 1) | (longest > WINDOW - GRAM + 1))
        if len(self.line_start):
            value, times = np.unique(self.line_keys(), return_counts=True)
            out.append(value)
            again.append(times > 1)
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return np.concatenate(out), np.concatenate(again)


def unit_keys(docs: DataFrame, line_words: int) -> DataFrame:
    """(key, doc_id, print, again): keys of every text's units; ``print`` tells texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "print"))
            for a, b, texts in text_slices(batch.column("text")):
                found = [Text(t, line_words).keys() for t in texts]
                n = [len(k) for k, _ in found]
                keys = np.concatenate([k for k, _ in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids[a:b], n)), pa.array(np.repeat(prints[a:b], n)), pa.array(np.concatenate([x for _, x in found]))], names=["key", "doc_id", "print", "again"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("print")).mapInArrow(run, "key long, doc_id long, print long, again boolean")


UNIT_SCHEMA = "kind byte, d1 long, d2 int, doc_id long, pos int, words int, start int, end int, kept_doc_id long"
UNIT_NAMES = [x.split()[0] for x in UNIT_SCHEMA.split(", ")]
#: Kinds of units: to be looked up by digest, or to be removed in any case.
OPEN, GONE = 0, 1
UNITS_AT_ONCE = 200_000


def text_units(text: str, live: np.ndarray | None, line_words: int = LINE_WORDS) -> list[np.ndarray]:
    """kind, d1, d2, pos, words, start, end of the text's units with a live key; without keys, what a copy loses."""
    t = Text(text, line_words)
    if live is None:
        pos, words = (np.array([0]), np.array([t.n])) if t.n >= WINDOW else (t.line_start, t.line_words)
        kind, d1, d2 = np.full(len(pos), GONE), np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int32)
    else:
        line = np.flatnonzero(np.isin(t.line_keys(), live)) if len(t.line_start) else np.zeros(0, np.int64)
        window = np.flatnonzero(np.isin(t.window_keys(), live))
        pos, words = np.concatenate([t.line_start[line], window]), np.concatenate([t.line_words[line], np.full(len(window), WINDOW)])
        h = t.run(pos, words)
        h[: len(line)] ^= LINE_SALT
        _, first, at = np.unique(h, return_index=True, return_inverse=True)
        again = pos - pos[first][at]  # words since the unit's first occurrence in this text
        kind = np.where(again >= np.repeat([1, WINDOW], [len(line), len(window)]), GONE, OPEN)
        d1, d2 = h.view(np.int64), (t.run(pos, words, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    if not len(pos):
        return []
    at = np.array([m.span() for m in TOKEN.finditer(text)], np.int32)
    return [kind.astype(np.int8), d1, d2, pos.astype(np.int32), words.astype(np.int32), at[pos, 0], at[pos + words - 1, 1]]


def candidate_units(wanted: DataFrame, line_words: int) -> DataFrame:
    """Units of the texts (doc_id, text, keys, original): those with a wanted key, or what a copy loses at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)]
            held.clear()
            kept = pa.array(columns.pop().to_numpy())
            return pa.RecordBatch.from_arrays([*columns, kept], names=UNIT_NAMES)

        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text")), batch.column("keys"), batch.column("original").to_pylist(), strict=True)
            for doc, text, keys, original in rows:
                found = text_units(text, np.asarray(keys.values).view(np.uint64) if original is None else None, line_words)
                if found:
                    n = len(found[0])
                    held.append([*found[:3], np.full(n, doc, np.int64), *found[3:], np.full(n, doc if original is None else original, np.int64)])
                    size += n
                if size >= UNITS_AT_ONCE:
                    yield out()
                    size = 0
        if held:
            yield out()

    return wanted.mapInArrow(run, UNIT_SCHEMA)


def repeated_spans(docs: DataFrame, work: Workspace | None = None, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, start, end, words, kept_doc_id): what to remove; kept_doc_id holds an earlier occurrence of part of it, or all of a copy."""
    spark = docs.sparkSession
    ship_package(spark)
    work = work or Workspace(spark, "substring")
    own = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "text").filter("text is not null")
    # copies: every text but the first of its kind
    prints = own.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("whole"))
    first = prints.groupBy("whole").agg(F.min("doc_id").alias("original"), F.max("doc_id").alias("last")).filter("original < last").drop("last")
    first = work.save(first, "first")  # a table, so that a join on one text's many copies can be split
    copies = work.save(prints.join(first, "whole").filter("doc_id > original").groupBy("doc_id").agg(F.min("original").alias("original")), "copies")
    # keys that occur in two texts, or twice in one
    keys = work.save(unit_keys(own, line_words), "keys")
    twice = keys.groupBy("key").agg(F.min("print").alias("a"), F.max("print").alias("b"), F.max("again").alias("again"))
    live = work.save(twice.filter("a < b or again").select("key"), "live")
    by_doc = keys.join(live, "key").join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    nothing = F.array().cast("array<bigint>")
    wanted = work.save(by_doc.withColumn("original", F.lit(None).cast("long")).unionByName(copies.withColumn("keys", nothing)), "wanted")
    units = work.save(candidate_units(own.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "keys", "original"), line_words), "units")
    work.release()
    for name in ("first", "copies", "keys", "live", "wanted"):
        work.remove(name)
    # of equal units the earliest stays
    found = units.filter(F.col("kind") == OPEN)
    firsts = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    firsts = work.save(firsts, "firsts")  # as with the texts: a common unit's join can be split
    place = ["doc_id", "pos", "words", "start", "end"]
    later = found.select("d1", "d2", *place).join(firsts, ["d1", "d2"]).filter("doc_id > first").select(*place, F.col("first").alias("kept_doc_id"))
    gone = later.unionByName(units.filter(F.col("kind") == GONE).select(*place, "kept_doc_id"))
    # units that touch make one span
    by_place = Window.partitionBy("doc_id").orderBy("pos", "words")
    reach = F.max(F.col("pos") + F.col("words")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    new = gone.withColumn("new", F.when(F.col("pos") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = new.groupBy("doc_id", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("pos") + F.col("words")) - F.min("pos")).cast("long").alias("words"), F.min("kept_doc_id").alias("kept_doc_id")
    )
    real = lambda c: F.when(F.col(c) != LEAST, F.col(c)).alias(c)
    return spans.select(real("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "words", real("kept_doc_id"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows with repeated spans cut out of their texts and n_chars brought up to date; emptied documents go."""
    spark, names = docs.sparkSession, docs.schema.names
    work, inner = (Workspace(spark, n) for n in ("substring-cut", "substring"))
    key, cuts, left = (free_name(docs, n) for n in ("cut_id", "cut_spans", "cut_text"))
    by_doc = repeated_spans(docs, inner).groupBy(F.coalesce("doc_id", F.lit(LEAST)).alias(key))
    spans = work.save(by_doc.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts)), "spans")
    inner.remove("")
    work.release()
    joined = docs.withColumn(key, F.coalesce("doc_id", F.lit(LEAST))).join(spans.hint("shuffle_hash"), key, "left")
    # text between spans, put together by the JVM
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col(cuts).getField("end"))
    ends = F.concat(F.col(cuts).getField("start"), F.array(F.length("text").cast("long")))
    gaps = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    cut = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.concat_ws("", gaps))
    out = joined.withColumn(left, cut).filter(F.col(cuts).isNull() | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    columns = {"text": F.col(left)} | ({"n_chars": F.length(left).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[columns.get(n, F.col(f"`{n}`")).alias(n) for n in names])


SQL = f"""
WITH d AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, t, length(regexp_extract(t, '^[\\x20\\x09-\\x0D]*')) AS lead, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') AS ps FROM d),
tok AS (SELECT doc_id, lead, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS pos FROM p),
w AS (SELECT doc_id, pos, regexp_extract(piece, '^[^\\x20\\x09-\\x0D]+') AS word, piece,
        lead + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
        coalesce(sum((contains(piece, chr(10)))::INT * (length(piece) - length(replace(piece, chr(10), '')))) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM tok),
n AS (SELECT doc_id, pos, s, s + length(word) AS e, line, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM w),
l AS (SELECT 0 AS kind, doc_id, min(pos) AS pos, count(*) AS words, min(s) AS s, max(e) AS e, md5(string_agg(x, ' ' ORDER BY pos)) AS g
      FROM n GROUP BY doc_id, line HAVING count(*) BETWEEN {LINE_WORDS} AND {WINDOW - 1}),
a AS (SELECT doc_id, list(x ORDER BY pos) AS xs, list(s ORDER BY pos) AS ss, list(e ORDER BY pos) AS es FROM n GROUP BY doc_id),
i AS (SELECT doc_id, xs, ss, es, unnest(range(1, len(xs) - {WINDOW - 2})) AS k FROM a WHERE len(xs) >= {WINDOW}),
v AS (SELECT 1 AS kind, doc_id, k - 1 AS pos, {WINDOW} AS words, ss[k] AS s, es[k + {WINDOW - 1}] AS e, md5(array_to_string(xs[k:k + {WINDOW - 1}], ' ')) AS g FROM i),
u AS (SELECT * FROM l UNION ALL SELECT * FROM v),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY kind, g) AS fd FROM u),
y AS (SELECT *, pos - min(pos) OVER (PARTITION BY kind, g, doc_id) >= CASE kind WHEN 0 THEN 1 ELSE {WINDOW} END AS again FROM f),
z AS (SELECT * REPLACE (CASE WHEN again THEN doc_id ELSE fd END AS fd) FROM y WHERE again OR fd <> doc_id),
m AS (SELECT *, max(pos + words) OVER (PARTITION BY doc_id ORDER BY pos, words ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM z),
k AS (SELECT *, sum(CASE WHEN pos <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos, words ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", (max(pos + words) - min(pos))::BIGINT AS words,
  CASE WHEN any_value(o.original) < doc_id THEN any_value(o.original) ELSE min(fd) END AS kept_doc_id
FROM k JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS original FROM d) o USING (doc_id) GROUP BY doc_id, island
"""
