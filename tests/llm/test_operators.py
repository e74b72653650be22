"""Operators against brute-force versions, on odd tables and on small ones."""

import io
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer


from helpers import DOCS, KINDS, SMALL, WORDS, empty, odd_documents, plain_components, plain_removed, sha
from textloom.llm import ann, bpe, cotrain, near_dup, packing, pii_crf, quality_rules, substring, tokenfile, warc

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# personal data ------------------------------------------------------------------------------------------------------
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    good = [lambda m: True, lambda m: all(int(x) <= 255 for x in m.group().split(".")), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good[k](m))


def test_base_spans_are_those_of_the_patterns():
    random.seed(5)
    parts = ["1", "25", "255", "4111111111111111", ".", "@", "a", "b-", "+", "+1 ", "(98", ") ", "-", " ", "é", "%", "555", "x.y", "\n"]
    for _ in range(20_000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        assert pii_crf.base_spans(text) == plain_spans(text), text


def test_personal_data(spark, small, odd):
    for docs in (small, odd):
        texts = sorted((sha(",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in plain_spans(r["text"] or ""))) for r in docs.collect()))
        rows = pii_crf.find_personal_data(docs).collect()
        assert sorted(r["base_sha256"] for r in rows) == texts
    assert pii_crf.find_personal_data(empty(spark)).count() == 0
    assert [r["text"] for r in pii_crf.redact_documents(odd).filter("doc_id = 9").collect()] == ["Mail [email] or [phone], [ip], [card]."]
    assert pii_crf.redact_documents(odd).filter("doc_id = 1 and text is null").count() == 1


def test_skip_edges_label_a_repeated_token():
    """A part of a phone that its document gives elsewhere is one; without the edge to it, it is not."""
    train = [f"call +1 ({i}) 555-{1000 + i} now. id {i * 7919} here" + (f" and +1 ({i}) 555-{1000 + i} or id {i * 7919}" if i % 2 else "") for i in range(200, 320)]
    model = pii_crf.fit(train)
    linked = "ring +1 (988) 555-2485 soon. " + "word " * 300 + "so 555-2485 again"
    (base, spans), = pii_crf.all_spans(model, [linked])
    assert [linked[a:b] for a, _, b in base] == ["+1 (988) 555-2485"]
    assert [(pii_crf.KINDS[k], linked[a:b]) for a, k, b in spans] == [("phone", "+1 (988) 555-2485"), ("phone", "555-2485")]
    g = pii_crf.Graph()
    g.add(0, linked, base)
    g.skip = []
    assert model.marginals(g)[-1, 4] < 0.6
    (_, alone), = pii_crf.all_spans(model, ["word " * 300 + "so 555-2485 again"])
    assert alone == []


def test_field_finds_what_the_patterns_miss():
    """Fitted on the driver's documents, asked about others with planted misses: what it adds is right, and it adds most."""
    import pandas as pd

    digits = re.compile("[0-9@]")
    texts = [t for t in pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["text"]).text.dropna() if digits.search(t)]
    model, rng = pii_crf.fit(texts[:500]), random.Random(5)
    words = [w for t in texts[500:] for w in t.split() if not digits.search(w)]
    found, wrong, missed = {}, 0, {}
    for i in range(200):
        text, truth = " ".join(rng.choices(words, k=30)), set()

        def put(s, kind=None):
            nonlocal text
            text += " " + s
            if kind is not None:
                truth.add((len(text) - len(s), kind, len(text)))

        case, phone = i % 4, f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        if case < 3:
            put(phone, 3)
        if case == 0:  # the pattern takes the address in, and then there are too many digits
            put(".".join(str(rng.randint(1, 250)) for _ in range(4)), 1)
        elif case == 3:
            put(rng.choice(["version 2.0.", "ref 55512", f'token = "{rng.getrandbits(160):040x}"', "in 1999 and 2004", "room 12-40", "no. 1234567"]))
        put(" ".join(rng.choices(words, k=50)))
        if case == 1:
            put(phone[-8:], 3)
        elif case == 2:
            put(phone[3:], 3)
        put("id " + str(rng.randint(10_000, 99_999)))
        (base, spans), = pii_crf.all_spans(model, [text])
        added = set(spans) - set(base)
        wrong += len(added - truth)
        found[case] = found.get(case, 0) + len(added & truth)
        missed[case] = missed.get(case, 0) + len(truth - set(spans))
    assert wrong == 0 and all(found[c] >= 45 for c in range(3)) and sum(missed.values()) <= 15


def test_long_tokens_and_many_spans():
    """No part of a token or of a long text is left out."""
    assert pii_crf.shape("a1" * 5000) == "a9" * 5000
    model = pii_crf.fit(["mail a.b@c.org now"])
    text = ",".join(f"a{i}@b.org" for i in range(5000))
    (base, spans), = pii_crf.all_spans(model, [text])
    assert len(base) == 5000 and set(base) <= set(spans)


def test_labels_reach_the_last_of_many_repeats():
    n, k = 40, 5
    table = 2.5 * (2 * np.eye(k) - 1)
    model = pii_crf.Model(np.zeros((pii_crf.FEATURES, k)), np.zeros((k, k)), table)
    step = np.exp(table) / np.exp(table).sum(axis=1, keepdims=True)
    g = pii_crf.Graph()
    g.doc, g.features, g.seen, g.skip = [7] * n + [9] * 2, [[0]] * (n + 2), [4, *[-1] * (n - 1), 1, -1], [(i, i + 1) for i in range(n + 1) if i != n - 1]
    p = model.marginals(g)
    assert p[n - 1] == pytest.approx(np.linalg.matrix_power(step, n - 1)[4], abs=1e-3) and p[n - 1, 4] > 0.3
    assert p[n + 1] == pytest.approx(step[1], abs=1e-3)


# nearest neighbours -------------------------------------------------------------------------------------------------
def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[100]  # a very common vector
    rows = [(i, x[i].tolist()) for i in range(3000)] + [(7, x[7].tolist()), (5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0]), (None, [1.0] * 16)]
    x, ids = np.vstack([x, [[1.0] + [0.0] * 15]]).astype(np.float32), np.array([*range(3000), 5060])  # a short vector is filled up with zeros
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cid int, K1 string")
    found = ann.nearest_neighbours(table).toPandas()
    assert found.query_id.nunique() == 151
    hit = 0
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        score = ann.exact(np.tile(x[ids == q], (len(ids), 1)), x)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hit += len(set(best) & set(g.vec_id))
        assert list(g["rank"]) == list(range(1, 21)) and list(g.score) == list(score[np.searchsorted(ids, g.vec_id)])
        if 100 <= q < 400:  # ties go to the smaller id
            assert list(g.vec_id) == list(best)
    assert hit / (20 * 151) >= 0.9
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest_neighbours(few).collect()] == [(0, 1, 1, 0.5)]


def test_candidates_are_few(spark, monkeypatch):
    """On the driver's vectors: recall over all queries, and the share of rows that is scored; blocks of queries change nothing."""
    x = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = np.array([r[0] for r in x.orderBy("vec_id").select("embedding").collect()], np.float64)
    found = ann.nearest_neighbours(x)
    near = {}
    for r in found.collect():
        near.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, len(v), 20):
        score = v @ v[q]
        score[q] = -np.inf
        hit += len(near[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit / (20 * len(near)) >= 0.95
    classes = x.selectExpr("vec_id as cid", "embedding", "vec_id % 20 = 0 as asked")
    share = ann.share_needed(classes, ann.Hasher(64, float(np.linalg.norm(v, axis=1).max())), v)
    assert share < 0.15
    monkeypatch.setattr(ann, "PASS_BYTES", 8 * 64 * 40)
    assert sorted(map(tuple, ann.nearest_neighbours(x).collect())) == sorted(map(tuple, found.collect()))


# tokenizing ---------------------------------------------------------------------------------------------------------
def test_codec_equals_the_library(spark, library, small, odd):
    for docs in (small, odd):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for r in bpe.encode_documents(docs, PATH).collect():
            ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["decoded"] == library.decode(ids, skip_special_tokens=False) and r["decoded_sha256"] == sha(r["decoded"])
    assert bpe.encode_documents(empty(spark), PATH).count() == 0


def test_every_code_point(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::3]
    texts = [f"a{chr(c)}b 1{chr(c)}" for c in points]
    config = bpe.vocabulary(PATH)
    wanted = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.ChunkEncoder(config).encode_all(texts) == wanted
    assert bpe.library_encoder(config).encode_all(texts) == wanted


def test_long_chunks_are_not_kept(library):
    texts = ["x" * 500 + " " + "ab" * 300 + ". short " + "z9" * 400, "x" * 500]
    for coder in (bpe.ChunkEncoder(bpe.vocabulary(PATH)), bpe.library_encoder(bpe.vocabulary(PATH))):
        for _ in range(2):
            assert coder.encode_all(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert max(map(len, coder.known)) <= bpe.LONGEST_KEPT
    from textloom.llm.common import LONGEST_KEPT, WordHashes

    store = WordHashes()
    words = [b"a", b"b" * 1000, b"a"]
    assert store.of(words).tolist() == store.of(words).tolist() and max(map(len, store.known)) <= LONGEST_KEPT


def test_trees_of_all_sizes(library):
    random.seed(1)
    table = bpe.MergeTable(bpe.vocabulary(PATH))
    words = ["".join(random.choice("aeinrst") for _ in range(n)) for n in [*range(1, 80), 511, 512, 513, 514, 5000]]
    wanted = [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert bpe.merge_words(table, [w.encode() for w in words]) == wanted


def test_bit_packing():
    rng = np.random.default_rng(0)
    for bits, n in itertools.product((1, 3, 8, 13, 16, 17, 31), (0, 1, 7, 8, 1001)):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        assert len(tokenfile.pack(ids, bits)) == -(-n * bits // 8)
        assert (tokenfile.unpack(tokenfile.pack(ids, bits), n, bits) == ids).all()
    ids = rng.integers(0, 50_000, 200_000).astype(np.uint32)
    s = tokenfile.Segment(tokenfile.build_segment([5, 6, 7], [70_000, 0, 130_000], ids, 16))
    assert (s.document(2) == ids[70_000:]).all() and len(s.document(1)) == 0 and (s.read(65_000, 66_000) == ids[65_000:66_000]).all()
    with pytest.raises(ValueError):
        tokenfile.Segment(b"x" * 100)


def test_a_document_is_read_by_its_blocks(tmp_path):
    """Opening a file reads its tables; a document, no more than the blocks that hold it."""
    ids = np.random.default_rng(1).integers(0, 50_000, 1_000_000).astype(np.uint32)
    (tmp_path / "x").write_bytes(tokenfile.build_segment(list(range(1000)), [1000] * 1000, ids, 16) + tokenfile.MARK)

    class Counted:
        def __init__(self, file):
            self.file, self.bytes, self.seek = file, 0, file.seek

        def read(self, n):
            self.bytes += n
            return self.file.read(n)

    with open(tmp_path / "x", "rb") as f:
        s = tokenfile.Segment(source := Counted(f))
        tables = source.bytes
        assert tables < 20_000 and (s.document(777) == ids[777_000:778_000]).all()
        assert source.bytes - tables <= 2 * 2 * tokenfile.BLOCK


def test_token_files(spark, library, odd, tmp_path):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    start, wanted = 0, []
    for known, doc, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        wanted.append((doc if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    made = tokenfile.token_file_digests(odd, PATH).collect()
    assert sorted(map(tuple, made), key=lambda r: r[1]) == wanted
    assert tokenfile.token_file_digests(empty(spark), PATH).count() == 0
    tokenfile.write_token_files(odd, PATH, str(tmp_path / "w"))
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*") if f.stat().st_size]
    assert sum(tokenfile.Segment(x).n_ids for x in files) == start and all(x.endswith(tokenfile.MARK) for x in files)


# packing ------------------------------------------------------------------------------------------------------------
def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, library, small, odd):
    for docs in (small, odd):
        rows = packing.pack_documents(docs, PATH).collect()
        pieces = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
        wanted = []
        for d in docs.collect():
            ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            wanted += [(d["doc_id"] is not None, d["doc_id"] or 0, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert pieces == sorted(wanted)
        lengths = [r["length"] for r in rows]
        assert check_packing(rows, 2048) <= best_fit_alone({n: lengths.count(n) for n in lengths})
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_plan_near_the_bound():
    rng = np.random.default_rng(4)
    for n in (1, 10, 1000, 50_000):
        lengths = np.minimum(2048, rng.lognormal(6, 1.2, n).astype(int) + 1)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = packing.Plan(histogram)
        placed = {}
        for group, count in plan.groups:
            assert sum(group) <= 2048
            for k in group:
                placed[k] = placed.get(k, 0) + count
        assert placed == histogram and plan.sequences <= best_fit_alone(histogram)


def best_fit_alone(histogram):
    alone = packing.Plan({})
    alone._best_fit(sorted(histogram.items(), reverse=True))
    return alone.sequences


def test_plan_of_the_driver_tables(library):
    """As few sequences as the tokens allow, most of the pieces placed by the program."""
    import pandas as pd

    lengths = []
    for e in library.encode_batch(pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["text"]).text.fillna("").tolist(), add_special_tokens=False):
        full, rest = divmod(len(e.ids) + 1, 2048)
        lengths += [2048] * full + [rest] * (rest > 0)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.Plan(histogram)
    assert plan.sequences == -(-sum(lengths) // 2048) == best_fit_alone(histogram)
    assert plan.by_program > 0.8 * sum(n < 2048 for n in lengths)


def test_knapsack_is_exact():
    rng = np.random.default_rng(7)
    for _ in range(20):
        value, most = np.append(0, rng.random(6)), np.append(0, rng.integers(0, 4, 6))
        counts, total = packing.best_configuration(value, most, 10)
        best = max(np.dot(c, value[1:]) for c in itertools.product(*(range(m + 1) for m in most[1:])) if np.dot(c, range(1, 7)) <= 10)
        assert total == pytest.approx(best) == pytest.approx(float(counts @ value)) and (counts <= most).all()


# near-duplicates ----------------------------------------------------------------------------------------------------
def family(seed, copies):
    """A text and copies of it with more and more words changed."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10_000)}" for _ in range(120)]
    out = [" ".join(base)]
    for i in range(copies):
        own = list(base)
        for _ in range(1 + i % 5):
            own[rng.randrange(120)] = f"n{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates(spark, odd):
    texts = [t for s in range(4) for t in family(s, 40)] + ["A b c d", "a B c d", "a b c", "", None, " "]
    random.Random(0).shuffle(texts)
    rows = list(enumerate(texts))
    made = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, made)) == plain_components(rows)
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    kept = near_dup.keep_first(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 5").count() == 0 and kept.filter("doc_id = 7").count() == 0
    assert kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id in (1, 2, 3)").count() == 3


def test_classes_that_centres_reject_meet_all_others(spark):
    """Pairs of alike classes in one bucket of many unlike ones: each pair is joined."""
    from textloom.session import Workspace

    rng = np.random.default_rng(8)
    shared, rows = [1, 2], []
    for i in range(12):
        marks = rng.integers(-(2**31), 2**31, 2 * near_dup.HALVES).tolist()
        for j in range(2):
            own = [1000 * (2 * i + j) + h for h in range(10, 10 + near_dup.HALVES - 2)]
            rows.append((2 * i + j, 100, [*shared, *own], marks))
    classes = spark.createDataFrame(rows, "rep long, n long, halves array<long>, marks array<int>")
    made = near_dup.candidate_joins(classes, Workspace(spark, "test-joins"))
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in made.collect()} == {(2 * i, 2 * i + 1) for i in range(12)}


def test_blocks_of_a_large_component(spark, monkeypatch):
    for name, value in (("BLOCK_SHINGLES", 500), ("BLOCK_SETS", 3), ("PARTNERS", 4), ("BLOCK_CLASSES", 5)):
        monkeypatch.setattr(near_dup, name, value)
    rows = list(enumerate(t for s in range(2) for t in family(s + 10, 30)))
    made = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, made)) == plain_components(rows)


# quality ------------------------------------------------------------------------------------------------------------
def test_base_counts():
    text = "a b c a b c x\n\nline # one\nline # one\n \n"
    assert quality_rules.base_counts(text) == (13, 23, 2, 1, 12)
    assert quality_rules.base_counts("") == (0, 0, 0, 0, 0)
    for seed in range(200):
        rng = random.Random(seed)
        w = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        assert quality_rules.base_counts(" ".join(w))[4] == len(covered)


def test_rules_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["kept"] <= (not r["base_failed"]) for r in rows)
    assert quality_rules.keep_good(odd, labels).columns == odd.columns
    none = quality_rules.score_documents(odd, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] == 0 for r in none)
    assert quality_rules.score_documents(empty(spark), labels).count() == 0


def test_co_training(spark, odd):
    rng = random.Random(3)
    good, bad = (lambda: " ".join(rng.choice(["river", "meadow", "stone", "cloud"]) for _ in range(60))), (lambda: " ".join(rng.choice(["$$$", "###", "zzz", "|||"]) for _ in range(60)))
    rows = [(i, good() if i % 3 else bad(), "en", "a" if i % 3 else "b", 300) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    made = {r["doc_id"]: r for r in cotrain.classify(docs, labels).collect()}
    held = [i for i in range(300, 600)]
    assert sum(made[i]["good"] == (i % 3 > 0) for i in held) / len(held) > 0.97
    rows = cotrain.classify(odd, labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.collect())
    again = [r for r in rows if r["doc_id"] == 4]
    assert len(again) == 2 and again[0] == again[1] and all(0 <= r["score"] <= 1 and r["good"] == (r["score"] >= 0.5) for r in rows)
    assert {r["score"] for r in cotrain.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert cotrain.classify(empty(spark), labels).count() == 0


def ranked(y, score):
    """Area under the curve; ties count half."""
    good, bad = score[y == 1][:, None], score[y == 0][None, :]
    return ((good > bad) + 0.5 * (good == bad)).mean()


def test_rounds_do_no_harm_on_the_driver_tables(spark):
    """Labels that the fit has not seen: no worse with rounds than without."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    unseen = labels.filter("pmod(xxhash64(doc_id, 1), 4) = 0")
    y = {r["doc_id"]: r["quality"] for r in unseen.collect()}
    made = []
    for rounds in (0, cotrain.ROUNDS):
        model = cotrain.fit_on(docs, labels.join(unseen, "doc_id", "left_anti"), rounds)
        rows = cotrain.classify(docs.join(unseen, "doc_id", "left_semi"), labels, model).collect()
        made.append(ranked(np.array([y[r["doc_id"]] for r in rows]), np.array([r["score"] for r in rows])))
    assert made[1] >= made[0] > 0.99


def test_rounds_help_where_views_are_apart():
    """Few labels, and two views that err apart: what one is sure of teaches the other."""
    rng = np.random.default_rng(2)

    def sample(n):
        y = rng.integers(0, 2, n)
        views = []
        for width in (1500, 1500):
            right = rng.random((n, 6)) < 0.75
            slot = rng.integers(0, width, (n, 6)) * 2 + np.where(right, y[:, None], 1 - y[:, None])
            views.append((slot.reshape(-1), np.full(6 * n, 0.4), np.full(n, 6)))
        return y, *views

    y, x, z = sample(600)
    pool_y, pool_x, pool_z = sample(20_000)
    test_y, test_x, test_z = sample(4000)
    given = ([], [])

    def ask(text, meta, wants, counts):
        out = []
        for (giver, kind), count in zip(wants, counts, strict=True):
            margin = (text.margin(pool_x), meta.margin(pool_z))[giver] * (1 if kind else -1)
            margin[given[1 - giver]] = -np.inf
            ids = np.sort(np.argsort(-margin)[:count])
            given[1 - giver].extend(ids.tolist())
            out.append((cotrain.rows_of(pool_x, ids), cotrain.rows_of(pool_z, ids)))
        return out

    plain, taught = cotrain.train(x, z, y), cotrain.train(x, z, y, ask, 8)
    a, b = (ranked(test_y, m.scores(test_x, test_z)[2]) for m in (plain, taught))
    assert len(given[0]) + len(given[1]) > 0 and b > a + 0.05


def test_a_weak_view_hands_nothing_to_a_strong_one():
    y = np.array([0, 1] * 50)
    strong, weak = (y - 0.5) * 4, np.tile([1.0, 1.0, -1.0, -1.0], 25)
    assert not cotrain.knows_better(weak, strong, y, 1) and not cotrain.knows_better(weak, strong, y, 0)
    assert cotrain.knows_better(strong, weak, y, 1) and cotrain.knows_better(strong, weak, y, 0)


# substrings ---------------------------------------------------------------------------------------------------------
def test_repeated_spans(spark, odd):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(3000)}"
    passage, line = [word() for _ in range(60)], " ".join(word() for _ in range(12))
    rows = []
    for i in range(30):
        own = [word() for _ in range(80)]
        if i % 3 == 0:
            own[40:40] = passage
        if i % 7 == 0:
            own[10:10] = ["the"] * 130
        text = " ".join(own)
        rows.append((i, text + ("\n" + line.upper() + "\n" if i % 4 == 0 else "") + (f"\n{line}" if i == 8 else "")))
    rows += [(40, rows[1][1]), (41, rows[1][1]), (42, "short line " * 5), (43, "short line " * 5)]
    made = {}
    for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r["doc_id"]]
        starts = [m.start() for m in WORDS.finditer(text)]
        made.setdefault(r["doc_id"], set()).update(range(starts.index(r["start"]), starts.index(r["start"]) + r["words"]))
        assert len(WORDS.findall(text[r["start"] : r["end"]])) == r["words"]
    assert made == {d: p for d, p in plain_removed(rows).items() if p}
    assert substring.repeated_spans(empty(spark)).count() == 0
    cut = substring.remove_repeats(odd)
    assert cut.columns == odd.columns and {r["cut_id"] for r in cut.collect()} == {6}
    left = {r["doc_id"]: r for r in cut.collect()}
    assert 5 not in left and left[7]["text"].strip() == "" or "tail" in left[7]["text"]
    assert {1, 2, 3, 4, 6, 8, 9, 10, None} <= set(left) and left[9]["text"] == odd.filter("doc_id = 9").first()["text"]


# archives -----------------------------------------------------------------------------------------------------------
def test_loser_tree():
    rng = random.Random(2)
    for k in range(12):
        runs = [sorted([(f"r{i}", j, rng.choice("abc"), "", rng.choice([None, 1, 2])) for j in range(rng.randint(0, 9))], key=warc.order) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted((x for r in runs for x in r), key=warc.order)


def test_archives(spark, tmp_path):
    rows = [(3, "http://www.B.org:80/x?q#f", "same"), (1, "http://a.b.org/y", "same"), (2, None, None), (4, "odd url\r\nX: 1", ""), (5, "http://b.org/x", "ü\r\n\r\nWARC/1.1\r\n"), (5, "http://b.org/x", "ü\r\n\r\nWARC/1.1\r\n"), (None, "http://z.org", "unique")]
    pages = spark.createDataFrame([(*r, "u") for r in rows], "page_id long, url string, html string, refers_to string")
    made = sorted(warc.archive_pages(pages).collect(), key=lambda r: r["capture_rank"])
    assert [r["capture_rank"] for r in made] == list(range(7))
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in made) == sorted(
        [("1", "response", None, 4), ("3", "revisit", 1, 4), ("2", "response", None, 0), ("4", "revisit", 2, 0), ("5", "response", None, 16), ("5", "response", None, 16), ("None", "response", None, 6)]
    )
    assert [r["url_key"] for r in made] == sorted(r["url_key"] for r in made)
    assert {r["payload_digest"] for r in made if r["page_id"] in (1, 3)} == {warc.digest(b"same")}
    assert warc.archive_pages(pages.limit(0)).count() == 0
    assert warc.url_key("http://www.B.org:80/x?q#f") == "org,b)/x?q"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(warc.record(1, None, "abc", None).replace(b"abc", b"abd"))))
    whole = warc.record(1, None, "abc", None) + warc.record(2, "http://a.b/", "abc", 1)
    found = list(warc.parse(io.BytesIO(whole)))
    assert [(h["WARC-Type"], p) for _, _, h, p in found] == [("response", b"abc"), ("revisit", b"")]
    assert all(whole[o : o + n].startswith(b"WARC/1.1") and whole[o + n : o + n + 4] == b"\r\n\r\n" for o, n, _, _ in found)
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(whole[:-9])))


def test_index_opens_records(spark, tmp_path, monkeypatch):
    """Each capture is read from its own gzip member alone; archives are closed at their size, and any gzip reader takes them."""
    import gzip

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rows = [(i, f"http://h{i % 3}.org/{i}", "x" * i + f"page {i // 2}") for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    index = warc.capture_history(spark, str(tmp_path / "w")).collect()
    assert len(index) == 60 and len({r["file"] for r in index}) == len([f for f in (tmp_path / "w").glob("part-*") if f.stat().st_size])
    for r in index:
        with open(tmp_path / "w" / r["file"], "rb") as f:
            headers, payload = warc.read_record(f, r["offset"], r["length"])
        assert headers["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>" and warc.digest(payload) == r["payload_digest"]
    for name in {r["file"] for r in index}:
        kinds = [h["WARC-Type"] for _, _, h, _ in warc.parse(io.BytesIO(gzip.decompress((tmp_path / "w" / name).read_bytes())))]
        assert kinds[0] == "warcinfo" and set(kinds[1:]) == {"response"}
