"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

A text is cut at white space; what stands between is encoded once and remembered. Inside, the vocabulary's
pattern yields words, whose bytes are the first symbols. For each word a segment tree keeps, at its leaves, the
rank of each adjacent pair (with its place, so ties go left); its root is the leftmost lowest-rank merge. A merge
changes three leaves, each repaired in logarithmic time. Trees of many words of like size are worked on together
as numpy rows, so the interpreter's cost is shared.

Null text is empty and gives no ids. Repeated rows give repeated rows. Very long words cost n log n.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import pick, text_slices
from textloom.session import ship_package

#: Fixed by the vocabulary's own configuration: its word pattern and the marker of a word's end.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
WORD_END = "</w>"
#: Code points below this are all assigned, and cover the Latin alphabets.
LOW = 0x250
#: Marks that often end a word, and control characters that str.split() takes for white space and the vocabulary does not.
MARKS = ".,;:!?|"
NOT_SPACE = "\x1c\x1d\x1e\x1f"
NONE = np.iinfo(np.int64).max
#: Words of more bytes than this are worked on one by one: few rows don't pay for numpy's calls.
LONG_WORD = 512
#: Chunks that a worker remembers, characters of the longest of them, and tree cells it works on at once.
CACHE_ENTRIES, LONGEST_KEPT, CELLS = 1_000_000, 64, 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def character_class(kind: str, end: int = 0x110000) -> str:
    """Ranges of the code points below ``end`` whose general category starts with ``kind``, for a regular expression.

    They come from the interpreter's Unicode tables; newer ones take letters in that the vocabulary's library leaves out.
    """
    inside = [unicodedata.category(chr(c)).startswith(kind) for c in range(end)]
    edges = np.flatnonzero(np.diff(np.array([False, *inside, False]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))


class MergeTable:
    """Vocabulary and merges as sorted numpy arrays."""

    def __init__(self, config: str):
        spec = json.loads(config)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.by_pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + WORD_END] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it can't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_words(table: MergeTable, words: list[bytes]) -> list[bytes]:
    """Ids of each word (not empty) as little-endian 32-bit integers, by segment trees over adjacent-pair ranks."""
    out: list = [None] * len(words)
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[i] = _merge_long(table, w)
            continue
        by_size.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
    for k, members in by_size.items():
        step = max(1, CELLS >> (k + 1))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            for i, ids in zip(part, _merge_rows(table, [words[i] for i in part], k), strict=True):
                out[i] = ids
    return out


def _merge_rows(table: MergeTable, words: list[bytes], k: int) -> list[bytes]:
    """The words have at most 2**k + 1 bytes, so that 2**k leaves hold their pairs."""
    n, rows = 1 << k, len(words)
    length = np.fromiter(map(len, words), np.int64, rows)
    raw = np.frombuffer(b"".join(w.ljust(n + 1, b"\0") for w in words), np.uint8).reshape(rows, n + 1)
    symbol = table.inner[raw]
    symbol[np.arange(rows), length - 1] = table.last[raw[np.arange(rows), length - 1]]
    place = np.arange(n + 1, dtype=np.int64)
    follow = np.broadcast_to(place + 1, (rows, n + 1)).copy()  # slot after each slot; >= length: none
    before = np.broadcast_to(place - 1, (rows, n + 1)).copy()
    live = place < length[:, None]
    tree = np.full((rows, 2 * n), NONE, np.int64)
    rank = table.rank(symbol[:, :-1], symbol[:, 1:])
    ok = (rank != NONE) & live[:, 1:]
    tree[:, n:][ok] = (rank * n + place[:-1])[ok]
    for level in range(k - 1, -1, -1):
        a, b = 1 << level, 2 << level
        np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2], out=tree[:, a:b])

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + n
        tree[row, node] = value
        for _ in range(k):
            low = np.minimum(tree[row, node], tree[row, node ^ 1])
            node = node >> 1
            tree[row, node] = low

    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        root = tree[row, 1]
        at, made = root % n, table.made[root // n]
        gone = follow[row, at]
        after = follow[row, gone]
        symbol[row, at] = made
        live[row, gone] = False
        follow[row, at] = after
        has_after = after < length[row]
        r, a = row[has_after], after[has_after]
        before[r, a] = at[has_after]
        inner = gone < n  # the last slot has no leaf of its own
        put(row[inner], gone[inner], np.full(int(inner.sum()), NONE))
        value = np.full(len(row), NONE)
        new = table.rank(made[has_after], symbol[r, a])
        value[has_after] = np.where(new == NONE, NONE, new * n + at[has_after])
        put(row, at, value)
        prior = before[row, at]
        has_prior = prior >= 0
        r, p = row[has_prior], prior[has_prior]
        new = table.rank(symbol[r, p], made[has_prior])
        put(r, p, np.where(new == NONE, NONE, new * n + p))
        row = row[tree[row, 1] != NONE]
    ids, ends = symbol[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _merge_long(table: MergeTable, word: bytes) -> bytes:
    """The same tree for one word, in plain lists."""
    raw, m = np.frombuffer(word, np.uint8), len(word)
    symbol = table.inner[raw]
    symbol[-1] = table.last[raw[-1]]
    n = 1 << max(1, (m - 1).bit_length())
    tree = np.full(2 * n, NONE, np.int64)
    rank = table.rank(symbol[:-1], symbol[1:])
    tree[n : n + m - 1] = np.where(rank == NONE, NONE, rank * n + np.arange(m - 1))
    size = n
    while size > 1:
        tree[size // 2 : size] = tree[size : 2 * size].reshape(-1, 2).min(axis=1)
        size //= 2
    tree, symbol, made, ranks = tree.tolist(), symbol.tolist(), table.made, table.by_pair
    follow, before = list(range(1, m + 1)), list(range(-1, m - 1))

    def put(leaf: int, value: int) -> None:
        node = leaf + n
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            low = value if value < other else other
            node >>= 1
            if tree[node] == low:
                return
            tree[node] = value = low

    while (root := tree[1]) != NONE:
        at = root % n
        symbol[at] = new = int(made[root // n])
        gone = follow[at]
        follow[at] = after = follow[gone]
        symbol[gone] = -1
        if gone < n:
            put(gone, NONE)
        found = None
        if after < m:
            before[after] = at
            found = ranks.get(new << 32 | symbol[after])
        put(at, NONE if found is None else found * n + at)
        if (prior := before[at]) >= 0:
            found = ranks.get(symbol[prior] << 32 | new)
            put(prior, NONE if found is None else found * n + prior)
    return np.array([x for x in symbol if x >= 0], "<u4").tobytes()


class ChunkEncoder:
    """Texts to ids by white-space chunks, each chunk's ids remembered as little-endian 32-bit bytes.

    words_to_ids: what encodes the words of chunks that aren't remembered, the segment trees by default.
    """

    def __init__(self, config: str, words_to_ids: Callable[[list[bytes]], list[bytes]] | None = None):
        import regex

        self.table = MergeTable(config)
        pattern = lambda end: WORD_PATTERN.replace("{L}", character_class("L", end)).replace("{N}", character_class("N", end))
        self.find, self.find_low = (regex.compile(pattern(end)).findall for end in (0x110000, LOW))
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.table.special)) + ")").split if self.table.special else None
        self.unknown = regex.compile(f"[{character_class('Cn')}]").search
        self.config, self.library = config, None
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.apart = regex.compile(r"[^\s]+").findall
        self.known: dict[str, bytes] = {}
        self.words_to_ids = words_to_ids or (lambda words: merge_words(self.table, words))

    def chunks(self, text: str) -> list[str]:
        """Normalised text between white space; a special token is a chunk with a space behind it."""
        if any(t in text for t in self.table.special):
            parts = self.cut_special(text)
            return [c for p in parts for c in ([p + " "] if p in self.table.special else self.chunks(p))]
        text = (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()
        return text.split() if not any(c in text for c in NOT_SPACE) else self.apart(text)

    def words(self, chunk: str) -> list[bytes]:
        """The pattern's words of a chunk."""
        if max(chunk) < chr(LOW):  # short classes suffice, and are ten times as fast
            return [w.encode() for w in self.find_low(chunk)]
        if self.unknown(chunk):  # newer than the interpreter's tables: ask the library
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.config)
            shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in shown]
        return [w.encode() for w in self.find(chunk)]

    def learn(self, chunks: list[str]) -> None:
        """Letters alone, or letters and one mark, need no pattern; that is most chunks."""
        known, plain, marked, other = self.known, [], [], []
        for c in chunks:
            if c.isalpha():
                plain.append(c)
            elif c[-1] in MARKS and c[:-1].isalpha():
                marked.append(c)
            elif c[-1] == " ":
                known[c] = np.array([self.table.special[c[:-1]]], "<u4").tobytes()
            else:
                other.append((c, self.words(c)))
        first = [c[:-1] for c in marked]
        plain = list(set(plain).union(set(first).difference(known)))
        known.update(zip(plain, self.words_to_ids([w.encode() for w in plain]), strict=True))
        rest = list({w for _, words in other for w in words}.union(map(str.encode, MARKS)))
        ids = dict(zip(rest, self.words_to_ids(rest), strict=True))
        mark = {m: ids[m.encode()] for m in MARKS}
        known.update(zip(marked, [known[w] + mark[c[-1]] for c, w in zip(marked, first, strict=True)], strict=True))
        for c, words in other:
            known[c] = b"".join([ids[w] for w in words])

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        cut = [self.chunks(t) for t in texts]
        new = list(set().union(*cut).difference(known))
        for at in range(0, len(new), 100_000):
            self.learn(new[at : at + 100_000])
        get = known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for c in new:
            if len(c) > LONGEST_KEPT:  # so that the store's bytes are bounded as well
                del known[c]
                known.pop(c[:-1], None)
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: without a decoder in its configuration, token names joined by spaces."""
        return b" ".join(map(self.table.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def library_encoder(config: str) -> ChunkEncoder:
    """Ids from the tokenizers library, asked once for each word of chunks that aren't remembered.

    The words, normalised and parted already, go to its model as one text that it cuts at spaces alone; the tokens
    that end words part them again.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_str(config)
    library.normalizer = None
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    library.no_truncation()
    library.no_padding()
    ends = np.array([x.endswith(WORD_END.encode()) for x in MergeTable(config).names])

    def ask(words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        text = b" ".join(words).decode()
        ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stop = (np.flatnonzero(ends[ids]) + 1) * 4
        if len(stop) != len(words) or (len(ids) and stop[-1] != 4 * len(ids)):
            return [array("I", e.ids).tobytes() for e in library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        raw, stop = ids.tobytes(), stop.tolist()
        return [raw[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    return ChunkEncoder(config, ask)


_encoders: dict[tuple[bool, str], ChunkEncoder] = {}


def encoder(config: str, library: bool = False) -> ChunkEncoder:
    """This worker's encoder for a vocabulary."""
    key = (library, hashlib.sha256(config.encode()).hexdigest())
    if key not in _encoders:
        if library:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = library_encoder(config) if library else ChunkEncoder(config)
    return _encoders[key]


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids array<int>, decoded) of each row."""
    ship_package(docs.sparkSession)
    config = vocabulary(tokenizer_path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(config)
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                coded = coder.encode_all(texts)
                shown = [coder.decode(x) for x in coded]
                columns = {
                    "doc_id": batch.column("doc_id")[a:b],
                    "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in shown]),
                }
                if keep_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array([x.decode() for x in shown])
                yield pa.RecordBatch.from_pydict(columns)

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)
