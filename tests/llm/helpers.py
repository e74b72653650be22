"""Odd tables, and brute-force versions of what the operators return."""

import hashlib
import itertools
import re

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Units of substring deduplication: least words of a line, and words of a window.
LINE_WORDS, WINDOW = 1, 50
KINDS = ("email", "ip", "card", "phone")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (None, "alone with a null id " * 20, None, "s", 10),
        (4, "same text twice over and over " * 15, "en", "s", 9),
        (4, "same text twice over and over " * 15, "en", "s", 9),
        (5, "same text twice over and over " * 15, "en", None, 9),
        (6, long, "en", "s", len(long)),
        (7, long + " tail", "de", "s", len(long) + 5),
        (8, "x" * 50_000, "en", "s", 50_000),
        (9, "Mail a.b@c-d.org or +1 (988) 555-2485, 10.0.0.255, 4111 1111 1111 1111.", "en", "s", 70),
        (10, "naïve Ünïcode 漢字 <|endoftext|> Σίσυφος İ", "el", "s", 40),
    ]
    extra = "key long, n long, bucket int, rules string, set binary, kind int, rep long, cut_id int"
    return spark.createDataFrame([(*r, 1, 2, 3, "x", b"y", 4, 5, 6) for r in rows], f"{DOCS}, {extra}")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_components(rows):
    sets, parent = [], {}
    for doc, text in rows:
        w = WORDS.findall(lower(text or ""))
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
        parent.setdefault(doc, doc)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((doc, len(s), find(doc), find(doc) == doc) for doc, s in sets)


def plain_removed(rows):
    """Removed word places of each document, by definition."""
    units = {}
    for doc, text in rows:
        words, at = [], 0
        for line in lower(text).split("\n"):
            own = WORDS.findall(line)
            if LINE_WORDS <= len(own) < WINDOW:
                units.setdefault(("line", tuple(own)), []).append((doc, at, len(own)))
            at += len(own)
            words += own
        for i in range(len(words) - WINDOW + 1):
            units.setdefault(("window", tuple(words[i : i + WINDOW])), []).append((doc, i, WINDOW))
    gone = {doc: set() for doc, _ in rows}
    for (kind, _), places in units.items():
        places.sort()
        for doc, at, n in places:
            first = min(p for d, p, _ in places if d == doc)
            if doc != places[0][0] or at - first >= (1 if kind == "line" else WINDOW):
                gone[doc] |= set(range(at, at + n))
    return gone
