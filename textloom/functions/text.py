"""Text kernels as column expressions. All run in the JVM but the normal form, whose NFKC Spark lacks: an Arrow UDF gives it whole."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.strip() and its regular expressions take it, for Java patterns.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What Python's \w matches, without code points that Java calls unassigned.
WORD = r"\p{L}\p{N}_"
#: English words counted as stopwords.
STOPWORDS = (
    "a an and are as at be but by for from has have he her his i if in into is it its me my not of on or our she so that "
    "the their them there they this to was we were what when where which who will with you your"
).split()
#: Punctuation whose distribution is measured, and what is stripped from sentences before they are compared.
PUNCTUATION = ".,;:!?()[]\"'—-"
SENTENCE_TRIM = " .,!?:;\"'()[]{}"
EDGES = rf"^[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+\z"
#: Sentence ends: after a mark or at line ends; and the stricter kind, before an ASCII capital, digit or quote.
SENTENCE_END = rf"(?<=[.!?])[{SPACE}]+|\n+"
SENTENCE_START = rf"(?<=[.!?])[{SPACE}]+(?=[A-Z0-9\"'])"


@F.arrow_udf(StringType())
def normal_form(texts: pa.Array) -> pa.Array:
    from textloom.functions.kernels import normal_form as one
    from textloom.functions.kernels import text_runs

    return pa.chunked_array([pa.array(map(one, run), pa.string()) for run in text_runs(texts)], pa.string()).combine_chunks()


def text_or_empty(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def strip(t: Column) -> Column:
    return F.regexp_replace(t, EDGES, "")


def normalize_newlines(t: Column, literal_escapes: bool = True) -> Column:
    """Every kind of line break as a line feed; also those spelled out with backslashes."""
    t = text_or_empty(t)
    if literal_escapes:
        t = F.replace(F.replace(t, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    return F.regexp_replace(t, r"\r\n|[\r\x0b\x0c\x{85}\x{2028}\x{2029}]", "\n")


def normalize_text(t: Column) -> Column:
    """NFKC, line breaks, outer white space, runs of blanks, then at most one empty line between paragraphs; empty for null."""
    return normal_form(text_or_empty(t))


def text_id(t: Column) -> Column:
    """SHA-1 of the UTF-8 text, in hex."""
    return F.sha1(F.encode(t, "UTF-8"))


def estimated_tokens(t: Column) -> Column:
    """About four characters a token, rounded up."""
    return F.floor((F.length(text_or_empty(t)) + 3) / 4).cast("int")


def suffix(path: Column) -> Column:
    """Lower-cased suffix of a path's last part; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def sentences(t: Column) -> Column:
    return non_empty(F.transform(F.split(strip(t), SENTENCE_END), strip))


def packing_sentences(t: Column) -> Column:
    """Sentences for packing: only before ASCII capitals, digits and quotes."""
    return non_empty(F.transform(F.split(t, SENTENCE_START), strip))


def paragraphs(t: Column) -> Column:
    return non_empty(F.transform(F.split(t, "\n\n"), strip))


def words(t: Column) -> Column:
    """Lower-cased runs of word characters."""
    return non_empty(F.split(F.regexp_replace(F.lower(t), rf"[^{WORD}{SPACE}]", " "), rf"[{SPACE}]+"))


def normalize_sentence(s: Column) -> Column:
    collapsed = F.regexp_replace(strip(F.lower(s)), rf"[{SPACE}]+", " ")
    return F.btrim(collapsed, F.lit(SENTENCE_TRIM))


def tail(t: Column, n: int) -> Column:
    """The last n characters, or all of a shorter text."""
    return F.right(t, F.lit(n))
