"""Text kernels in Python, for Arrow batches: normal form, windows, and the eleven features of a text.

A text is handled in time that is linear in its length, up to sorting.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.functions.text import PUNCTUATION, SENTENCE_TRIM, STOPWORDS

#: Bytes of text that one step holds as Python objects.
STEP_BYTES = 1_000_000
#: Shorter texts have entropy 0: characters for trigrams, tokens for words.
LEAST_CHARS, LEAST_WORDS = 20, 20
#: Longest n-gram that is looked for twice.
LONGEST_GRAM = 12
STOP = frozenset(STOPWORDS)
_BREAKS = re.compile("\r\n|[\r\x0b\x0c\x85  ]")
_BLANKS = re.compile(r"[ \t]{2,}|\t")
_GAPS = re.compile(r"\n{3,}")
_BEFORE_START = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
_MARKS = re.compile(r"[^\w\s]")


def text_runs(column: pa.Array, step: int = STEP_BYTES) -> Iterator[list[str]]:
    """The column's texts in runs of about ``step`` bytes; a null text is empty."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + step, side="right")))
        yield [t or "" for t in column.slice(start, end - start).to_pylist()]
        start = end


def normal_form(t: str) -> str:
    """NFKC, line breaks (also spelled out), outer white space, runs of blanks, at most one empty line between paragraphs."""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    if "\\" in t:
        t = t.replace("\\r\\n", "\n").replace("\\n", "\n")
    t = _BLANKS.sub(" ", _BREAKS.sub("\n", t).strip())
    return _GAPS.sub("\n\n", t) if "\n\n\n" in t else t


def token_estimate(t: str) -> int:
    return (len(t) + 3) // 4


def units_of(normal: str, most: int) -> Iterator[tuple[str, int, bool]]:
    """Text, tokens and group of what windows are made of: paragraphs that fit, and sentences of those that don't.

    Paragraphs in a row are one group, and the sentences of one paragraph are one; windows never join two groups.
    """
    group, after_sentences = 0, False
    for p in normal.split("\n\n"):
        if not (p := p.strip()):
            continue
        cost = token_estimate(p)
        if cost <= most:
            group += after_sentences
            after_sentences = False
            yield p, cost, group
        elif sentences := [s for s in map(str.strip, _BEFORE_START.split(p)) if s]:
            group, after_sentences = group + 1, True
            for s in sentences:
                yield s, token_estimate(s), -group


def packed(normal: str, most: int) -> list[str]:
    """Windows of a normal form: units are numbered first, then each window is joined once.

    The budget leaves separators out, and one unit may exceed it.
    """
    if not normal:
        return []
    if token_estimate(normal) <= most:
        return [normal]
    windows: list[tuple[int, list[str]]] = []
    used, at = 0, 0
    for text, cost, group in units_of(normal, most):
        if not windows or group != at or used + cost > most:
            windows.append((group, []))
            used = 0
        windows[-1][1].append(text)
        used, at = used + cost, group
    return [(" " if group < 0 else "\n\n").join(parts) for group, parts in windows]


def windows(normal: str, most: int, overlap: int = 0) -> list[str]:
    """``packed``, each window after the first with the end of the one before it in front."""
    plain = packed(normal, most)
    if overlap <= 0:
        return plain
    return plain[:1] + [f"{before[-4 * overlap :]}\n\n{w}".strip() for before, w in zip(plain, plain[1:], strict=False)]


def entropy(counts: np.ndarray) -> float:
    """Base-2 entropy of positive counts; 0 without any."""
    if not len(counts):
        return 0.0
    p = counts / counts.sum()
    return abs(float((p * np.log2(p)).sum()))


def runs_in_order(keys: np.ndarray) -> np.ndarray:
    """How often each distinct key stands there."""
    keys = np.sort(keys)
    edge = np.flatnonzero(keys[1:] != keys[:-1])
    return np.diff(np.concatenate([[-1], edge, [len(keys) - 1]]))


def trigram_entropy(low: str) -> float:
    """Of characters of the text in lower case, with each run of white space as one blank."""
    s = " ".join(low.split())
    if len(s) < LEAST_CHARS:
        return 0.0
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return entropy(runs_in_order(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))


def gram_measures(ids: np.ndarray) -> tuple[float, int]:
    """Distinct trigrams over trigrams, and the longest n-gram that recurs, n growing while one does.

    N-grams are ranked by the rank of their first n - 1 tokens and the last token, so no n-gram is ever built.
    """
    n, ratio, longest = len(ids), 1.0, 0
    if n < 4:
        return ratio, longest
    base, rank = int(ids.max()) + 1, ids
    for size in range(2, LONGEST_GRAM + 1):
        if n < 2 * size and size > 3:
            break
        value, rank = np.unique(rank[: n - size + 1] * base + ids[size - 1 :], return_inverse=True)
        if size == 3:
            ratio = len(value) / (n - 2)
        if len(value) < n - size + 1 and n >= 2 * size and longest == (size - 1 if size > 2 else 0):
            longest = size
        elif size >= 3:
            break
    return ratio, longest


def sample_variance(x: list[float]) -> float:
    if len(x) < 2:
        return 0.0
    mean = sum(x) / len(x)
    return sum((v - mean) ** 2 for v in x) / (len(x) - 1)


def features(t: str) -> tuple:
    """The eleven features, in the order of heuristics.FEATURES."""
    low = t.lower()
    sentences = [s for s in map(str.strip, _SENTENCE_END.split(low.strip())) if s]
    by_sentence = [_MARKS.sub(" ", s).split() for s in sentences]
    tokens = [w for s in by_sentence for w in s]
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in tokens], np.int64)
    ratio, longest = gram_measures(ids)
    again = 0.0
    if len(sentences) > 1:
        again = (len(sentences) - len({" ".join(s.split()).strip(SENTENCE_TRIM) for s in sentences})) / len(sentences)
    marks = np.array([c for c in map(t.count, PUNCTUATION) if c], float)
    stops = [sum(map(STOP.__contains__, s)) / len(s) if s else 0.0 for s in by_sentence]
    words = entropy(np.bincount(ids)) if len(tokens) >= LEAST_WORDS else 0.0
    return (ratio, longest, again, sample_variance([float(len(s)) for s in by_sentence]), entropy(marks), sample_variance(stops), trigram_entropy(low), words, len(sentences), len(tokens), len(t))
