"""Queries against their SQL on the small tables, and the pipeline stage by stage."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from helpers import SMALL, WORDS, empty, odd_documents, plain_components, plain_removed
from textloom.llm import queries as q


def rows_of(frame, columns):
    return sorted(repr(tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def tables():
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def same_kind(frame):
    return frame.assign(refers_to=[None if pd.isna(v) else int(v) for v in frame.refers_to]) if "refers_to" in frame else frame


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    made, wanted = same_kind(q.QUERIES[name](spark, SMALL).toPandas()), same_kind(tables.sql(q.ORACLE_SQL[name]).df())
    assert len(made) and sorted(made.columns) == sorted(wanted.columns)
    assert rows_of(made, sorted(made.columns)) == rows_of(wanted, sorted(made.columns))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, tables):
    import corpus_pipeline as p
    from textloom.llm import pii_crf
    from textloom.session import Workspace

    work, docs = Workspace(spark, "test"), spark.read.parquet(f"{SMALL}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        docs = work.save(stage(spark, docs, SMALL), f"s{k}")
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[-1] == sizes[-2] and sizes[-1] > sizes[0] // 2
    assert all(not pii_crf.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in docs.select("text", "n_chars").collect())
    packed = p.run(spark, SMALL)
    # the same by plain versions of each stage; what the random field adds is its own
    raw = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    good = [r[0] for r in tables.sql(f"SELECT doc_id FROM ({q.ORACLE_SQL['op7_ngram_ratio_rules']}) WHERE kept ORDER BY doc_id").fetchall()]
    first = [r[0] for r in plain_components([(d, raw[d]) for d in good]) if r[3]]
    texts = {}
    for d, gone in plain_removed([(d, raw[d]) for d in first]).items():
        at = [m.span() for m in WORDS.finditer(raw[d])]
        out, done = [], 0
        for k in sorted(gone):
            if k - 1 not in gone:
                out.append(raw[d][done : at[k][0]])
            done = at[k][1] if k + 1 not in gone else done
        texts[d] = "".join([*out, raw[d][done:]])
    texts = {d: t for d, t in texts.items() if (WORDS.search(t) or not WORDS.search(raw[d]))}
    model = pii_crf.fit([t for t in texts.values() if re.search("[0-9@]", t)])
    library = Tokenizer.from_file(q.WORD_BPE)
    library.no_truncation()
    library.no_padding()
    wanted = []
    for d, t in texts.items():
        ids = np.array([*library.encode(pii_crf.redact(t, pii_crf.all_spans(model, [t])[0][1]), add_special_tokens=False).ids, 0], "<u4")
        wanted += [(d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect()) == sorted(wanted)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, long texts, repeats and clashing columns pass all stages; an empty table gives no rows."""
    import corpus_pipeline as p

    odd = odd_documents(spark)
    text = " ".join(f"u{i}" for i in range(9000)) + " a.b@c.org"
    more = [(20, text, None, None, None), (21, text + " tail", "en", "s", -1), (21, text + " tail", "en", "s", -1), (22, "\n".join(f"v{i} {i * i}" for i in range(300)), "en", None, 3), (None, " ".join(f"n{i}" for i in range(60)), "en", "s", 0)]
    odd = odd.union(spark.createDataFrame([(*r, 1, 2, 3, "x", b"y", 4, 5, 6) for r in more], odd.schema))
    labels = spark.createDataFrame([(20, 1, 0), (22, 1, 0), (22, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("empty", empty(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        (labels if name == "odd" else labels.limit(0)).write.parquet(str(tmp_path / name / "labels.parquet"))
    rows = p.run(spark, str(tmp_path / "odd")).collect()
    assert {20, 22} <= {r["doc_id"] for r in rows} <= {20, 22, None} and sum(r["length"] for r in rows if r["doc_id"] == 20) > 9000
    assert p.run(spark, str(tmp_path / "empty")).count() == 0
