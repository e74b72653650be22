"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The base patterns take the longest run and drop it if it fails, so a phone before another number is missed, and so is a
part of a number given before. Nodes of the field are the tokens of a document that hold a digit or an at sign; no other
token can be of a kind. Unary potentials come from hashed shape and context features, chain edges join neighbouring
tokens, and skip edges join a token to the next one in the document, however far, of the same form (its letters and
digits in lower case) or a similar one (the same last seven digits, the same name before an at sign). Tokens inside base
spans are observed. Loopy sum-product message passing over all edges then makes labels agree along the chain and between
repeats. Runs of tokens whose label is certain enough become further spans if they can be of that kind: enough digits,
for cards the check digit, for addresses their parts. Edges are linear in the tokens.

The potentials are fitted together by pseudo-likelihood: each token's label given those of its neighbours. Labels are
those of the base spans; a token without one that neighbours one, or repeats one, is latent: it is no example, as it may
have been missed, nor does it tell its repeats a label. A random half of the features is hidden from each token in each step,
so context and neighbours count even where the format is plain. The fit takes at most ``TRAIN_NODES`` tokens, the first
by hash, of at most ``TRAIN_DOCS`` documents of any length, whose tokens executors make; it is the same for the same
documents. Finding spans reads every text whole. Null text is empty and has no spans. Rows with equal doc_id are each
read; spans that tie for a start are in order of the kind, and overlapping ones stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import pick, text_slices
from textloom.session import ship_package

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_NODES, FEATURES, STEPS, ROUNDS, CERTAIN = 3000, 50_000, 1 << 12, 200, 12, 0.9
#: Share of a token's features that a step of the fit hides.
HIDDEN = 0.5
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN, TRIM = re.compile(r"[^\x20\x09-\x0D]+"), ".,;:!?\"'<>|[]{}"
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and then kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, 0, done := m.end()))
        at = text.find("@", m.end() if m else at + 1)
    if "." in text:
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


def shape(token: str) -> str:
    """The token with letters as a, digits as 9, and runs shortened to their length's class."""
    t = re.sub(r"[^\W\d_]+", "a", token)
    return re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 5), t)


def similar(token: str) -> list[tuple[str, str]]:
    """What tokens that share a skip edge have in common: a form, the last seven digits, or the name of an address."""
    form = "".join(c for c in token.lower() if c.isalnum())
    keys = [("form", form)] if len(form) >= 4 else []
    digits = "".join(c for c in token if c in "0123456789")
    if len(digits) >= 7 and len(digits) == len(form):
        keys.append(("digits", digits[-7:]))
    name = "".join(c for c in token.lower().split("@")[0] if c.isalnum()) if "@" in token else form
    if len(name) >= 6 and not name.isdigit():
        keys.append(("name", name))
    return keys


class Graph:
    """Nodes and edges of some documents together."""

    def __init__(self):
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        self.seen: list[int] = []  # observed label, or -1
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.known: dict[str, int] = {}

    def slot(self, name: str) -> int:
        if len(self.known) > 50_000:
            self.known.clear()
        if (k := self.known.get(name)) is None:
            k = self.known[name] = slot(name)
        return k

    def add(self, doc: int, text: str, spans: list[Span]) -> None:
        last: dict[tuple[str, str], int] = {}
        before, before_node, at = "", -1, 0
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        for i, (a, b) in enumerate(tokens):
            raw = text[a:b]
            if not ("@" in raw or any(map(str.isdigit, raw))):
                before, before_node = raw, -1
                continue
            a += len(raw) - len(raw.lstrip(TRIM))
            token = raw.strip(TRIM)
            b = a + len(token)
            while at < len(spans) and spans[at][2] <= a:
                at += 1
            label, k = 0, at
            while not label and k < len(spans) and spans[k][0] < b:
                label, k = (spans[k][1] + 1 if spans[k][2] > a else 0), k + 1
            after = text[tokens[i + 1][0] : tokens[i + 1][1]] if i + 1 < len(tokens) else ""
            digits = sum(map(str.isdigit, token))
            checked = digits > 12 and luhn("".join(c for c in token if c in "0123456789"))
            names = [f"s:{shape(token)}", f"d:{min(digits, 20)}", f"n:{min(len(token), 40)}", f"b:{before[-12:].lower()}", f"p:{shape(before)}", f"f:{shape(after)}", f"q:{shape(before)} {shape(token)}", f"l:{checked}", f"c:{min(digits, 20)} {checked}"]
            node = len(self.doc)
            self.doc.append(doc)
            self.span.append((a, b))
            self.features.append([self.slot(n) for n in names])
            self.seen.append(label or -1)
            if before_node >= 0:
                self.chain.append((before_node, node))
            for key in similar(token):
                if key in last:
                    self.skip.append((last[key], node))
                last[key] = node
            before, before_node = raw, node


class Model:
    """Unary weights (features by labels) and log potentials of chain and skip edges; label 0 is none."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product in the log domain, with damping; observed nodes are clamped.

        Messages go on until a document's converge, for ROUNDS and two more for each repeat in its longest chain of repeats at most.
        """
        k = len(KINDS) + 1
        unary = self.weights[np.array(g.features)].sum(axis=1)
        seen = np.array(g.seen)
        for j in np.flatnonzero(seen >= 0):
            unary[j] = -30.0
            unary[j, seen[j]] = 0.0
        pairs = np.array([*g.chain, *g.skip], np.int64).reshape(-1, 2)
        kind = np.repeat([0, 1], [len(g.chain), len(g.skip)])
        tables = np.stack([self.chain, self.skip])[kind]
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        reverse = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(source), k))
        # each document stops by itself, so its labels do not depend on what it is read with
        doc = np.unique(np.array(g.doc), return_inverse=True)[1]
        depth, most = np.zeros(len(doc), np.int64), np.full(doc.max(initial=-1) + 1, ROUNDS)
        for a, b in g.skip:
            depth[b] = max(depth[b], depth[a] + 1)
        np.maximum.at(most, doc, ROUNDS + 2 * depth)
        live = np.arange(len(source))
        for step in range(1, most.max(initial=0) + 1):
            if not len(live):
                break
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = belief[source[live]] - message[reverse[live]]
            new = np.logaddexp.reduce(out[:, :, None] + tables[live], axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            change = np.zeros(len(most))
            np.maximum.at(change, doc[source[live]], np.abs(new - message[live]).max(axis=1))
            message[live] = 0.3 * message[live] + 0.7 * new
            live = live[((change >= 1e-4) & (step < most))[doc[source[live]]]]
        belief = unary
        np.add.at(belief, target, message)
        belief -= np.logaddexp.reduce(belief, axis=1, keepdims=True)
        return np.exp(belief)


Nodes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def training_nodes(texts: list[str]) -> Nodes:
    """Features, label, label of the token before and after, sums of the labels that skip edges bring (a column each), and a hash.

    Latent nodes are left out; along the chain they count as none, to their repeats they tell nothing.
    """
    g = Graph()
    for i, t in enumerate(texts):
        g.add(i, t, base_spans(t))
    n, k = len(g.doc), len(KINDS) + 1
    label = np.maximum(np.array(g.seen, np.int64), 0)
    latent = np.zeros(n, bool)
    for a, b in (*g.chain, *g.skip):
        latent[a] |= label[b] > 0
        latent[b] |= label[a] > 0
    latent &= label == 0
    told = np.where(latent, -1, label)
    left, right, skips = np.full(n, -1), np.full(n, -1), np.zeros((n, k), np.int64)
    for a, b in g.chain:
        right[a], left[b] = label[b], label[a]
    for a, b in g.skip:
        for own, other in ((a, b), (b, a)):
            if told[other] >= 0:
                skips[own, told[other]] += 1
    features = np.array(g.features, np.int64).reshape(n, -1)
    salt = np.array([int.from_bytes(hashlib.blake2b(f"{s} {texts[d]}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for d, s in zip(g.doc, g.span, strict=True)], np.int64)
    return tuple(x[~latent] for x in (features, label, left, right, skips, salt))


def fit_nodes(nodes: Nodes) -> Model:
    """Unary, chain and skip potentials together, by pseudo-likelihood."""
    x, label, left, right, skips, _ = nodes
    n, k = len(label), len(KINDS) + 1
    weights, chain, skip = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))
    if not label.any():
        weights[:, 0] = 1.0
        return Model(weights, chain, skip)
    some_left, some_right, rng = np.flatnonzero(left >= 0), np.flatnonzero(right >= 0), np.random.default_rng(11)
    parts = [weights, chain, skip]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        shown = rng.random(x.shape) >= HIDDEN
        score = (weights[x] * shown[:, :, None]).sum(axis=1) + skips @ skip
        score[some_left] += chain[left[some_left]]
        score[some_right] += chain.T[right[some_right]]
        p = np.exp(score - np.logaddexp.reduce(score, axis=1, keepdims=True))
        p[np.arange(n), label] -= 1
        p /= n
        grads = [1e-5 * weights, 1e-4 * chain, 1e-4 * skip + skips.T @ p]
        for j in range(x.shape[1]):
            np.add.at(grads[0], x[:, j], p * shown[:, j : j + 1])
        np.add.at(grads[1], left[some_left], p[some_left])
        np.add.at(grads[1].T, right[some_right], p[some_right])
        grads[2] = (grads[2] + grads[2].T) / 2  # a skip edge has no direction
        for i, (part, grad) in enumerate(zip(parts, grads, strict=True)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.99 * v[i] + 0.01 * grad**2
            part -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    return Model(weights * (1 - HIDDEN), chain, skip)


def fit(texts: list[str]) -> Model:
    """As ``fit_on`` on so many texts."""
    nodes = training_nodes(sorted(set(texts)))
    order = np.argsort(nodes[-1], kind="stable")[:TRAIN_NODES]
    return fit_nodes(tuple(x[order] for x in nodes))


def fit_on(docs: DataFrame) -> Model:
    """Fit on tokens of the sample: the first documents with a digit or an at sign by hash of their id."""
    ship_package(docs.sparkSession)
    usable = pick(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    own = usable.join(F.broadcast(chosen), "doc_id").select("text").distinct()  # at most TRAIN_DOCS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_slices(batch.column("text")):
                features, label, left, right, skips, salt = training_nodes(texts)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (features, skips) if len(x)]
                if lists:
                    yield pa.RecordBatch.from_arrays([lists[0], *map(pa.array, (label, left, right)), lists[1], pa.array(salt)], names=["features", "label", "before", "after", "skips", "salt"])

    made = own.mapInArrow(run, "features array<long>, label long, before long, after long, skips array<long>, salt long")
    rows = made.orderBy("salt", "features", "label").limit(TRAIN_NODES).toArrow()
    n, k = rows.num_rows, len(KINDS) + 1
    one = lambda c: rows.column(c).to_numpy()
    many = lambda c, w: pc.list_flatten(rows.column(c)).to_numpy().reshape(n, w)
    width = len(rows.column("features")[0]) if n else 1
    return fit_nodes((many("features", width), one("label"), one("before"), one("after"), many("skips", k), one("salt")))


def can_be(kind: int, text: str) -> bool:
    """Whether a text can be of the kind at all."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == 0:
        name, _, domain = text.partition("@")
        return bool(name and DOMAIN.match(domain))
    if kind == 1:
        return bool((m := IP.fullmatch(text)) and all(int(x) <= 255 for x in m.group().split(".")))
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def found_in(run: list[tuple[int, int]], kind: int, text: str) -> Iterator[Span]:
    """Spans in a run of tokens that are certain to be of a kind: the longest parts that can be, from the left.

    A token of a run holds a digit, so no part of more than 19 tokens can be.
    """
    i = 0
    while i < len(run):
        for j in range(min(len(run), i + 19), i, -1):
            if can_be(kind, text[run[i][0] : run[j - 1][1]]):
                yield run[i][0], kind, run[j - 1][1]
                i = j - 1
                break
        i += 1


def all_spans(model: Model, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans of each text, and those with what the field adds."""
    base = [base_spans(t) if t else [] for t in texts]
    g = Graph()
    for i, (t, own) in enumerate(zip(texts, base, strict=True)):
        if DIGIT_OR_AT.search(t):
            g.add(i, t, own)
    more: dict[int, list[Span]] = {}
    if g.doc:
        p = model.marginals(g)
        best = p.argmax(axis=1)
        sure = (best > 0) & (p.max(axis=1) >= CERTAIN) & (np.array(g.seen) < 0)
        linked, runs = set(g.chain), []
        last = None
        for j in np.flatnonzero(sure).tolist():
            if last is not None and (last, j) in linked and best[last] == best[j]:
                runs[-1][2].append(g.span[j])
            else:
                runs.append((g.doc[j], int(best[j]) - 1, [g.span[j]]))
            last = j
        for doc, kind, run in runs:
            more.setdefault(doc, []).extend(found_in(run, kind, texts[doc]))
    return [(own, sorted([*own, *more.get(i, ())])) for i, own in enumerate(base)]


DIGIT_OR_AT = re.compile(r"[0-9@]")


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row; counts are of base spans."""
    model = model or fit_on(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                found = all_spans(model, texts)
                counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
                sums = [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *(pa.array(c, pa.int64()) for c in counts), pa.array(sums), pa.array([shown(s) for _, s in found])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, put as its first kind in brackets."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k]}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every row with its text redacted (null stays null) and, where there is one, n_chars brought up to date."""
    model = model or fit_on(docs)
    names = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                part = batch.slice(a, b - a)
                null, columns = part.column("text").is_null().to_pylist(), list(part.columns)
                new = [None if x else redact(t, spans) for t, x, (_, spans) in zip(texts, null, all_spans(model, texts), strict=True)]
                columns[names.index("text")] = pa.array(new, pa.string())
                if "n_chars" in names:
                    columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(batch.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
