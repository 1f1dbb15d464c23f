"""Text normalisations. They differ on purpose: scores depend on which one is used where.

All are Column expressions; only Unicode composition and places of words, which Spark has no function for, are Arrow functions.
Upper-case dotted and dotless I are settled before ``lower``, which differs between engines for them. A
non-word character is written as a class of letters, numbers and underscore, which means the same in Java
and in other engines.
"""

from __future__ import annotations

import html
import string
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Glyphs of broken fonts and the letters they stand for.
GLYPHS = {"›": "ı", "ﬂ": "ş", "ﬁ": "Ş", "¤": "ğ", "‹": "İ", "Ý": "İ", "ý": "ı", "Þ": "Ş", "þ": "ş", "Ð": "Ğ", "ð": "ğ", "Ġ": "İ", "ġ": "ş", "⁄": "ğ"}
SHORT_GLYPHS = {"Ġ": "İ", "ġ": "ş", "Ý": "İ", "ý": "ı", "Þ": "Ş", "þ": "ş", "Ð": "Ğ", "ð": "ğ"}
MOJIBAKE = {"Ġ": "İ", "ġ": "ş", "Ý": "İ", "ý": "ı", "Þ": "Ş", "þ": "ş", "Ð": "Ğ", "ð": "ğ", "Ÿ": "Y", "›": "ı", "¤": "ğ", "Ģ": "ş", "": "ı", "ß": "ş"}
HEADING_LOWER = {"İ": "i", "I": "ı", "Ç": "ç", "Ş": "ş", "Ğ": "ğ", "Ü": "ü", "Ö": "ö", "Ý": "i", "ý": "ı", "Þ": "ş", "þ": "ş", "Ð": "ğ", "ð": "ğ"}
TURKISH_FOLD = ("çğıöşü", "cgiosu")
SOFT_FOLD = ("çğıöşüâîû", "cgiosuaiu")
SCORE_FOLD = ("çğıİöşüÇĞÖŞÜ", "cgiiosuCGOSU")
BIBLIOGRAPHY_FOLD = ("ışğüöç", "isguoc")
ACADEMIC_TITLES = ("prof", "dr", "doç", "doc", "uzman", "uzm", "araş", "aras", "gör", "gor", "yrd", "öğr", "ogr")

NON_WORD = r"[^\p{L}\p{N}_]"
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _translate(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def turkish_lower(c: Column) -> Column:
    """I becomes dotless, dotted İ plain i, then lower case."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def glyph_lower(c: Column) -> Column:
    """Repairs glyphs and lowers, keeping diacritics."""
    return turkish_lower(_translate(c, GLYPHS))


def norm_word(c: Column) -> Column:
    """A word for span search: repaired, lowered, folded, without non-word characters."""
    return F.regexp_replace(F.translate(glyph_lower(c), *TURKISH_FOLD), NON_WORD, "")


def soft_norm(c: Column, fold: bool = False, compose: bool = False) -> Column:
    """Case, punctuation and spaces ignored; diacritics too if fold. compose adds canonical composition."""
    low = turkish_lower(nfc(c) if compose else c)
    return F.regexp_replace(F.translate(low, *SOFT_FOLD) if fold else low, NON_WORD, "")


def strict_norm(c: Column) -> Column:
    return collapse(c)


def list_norm(c: Column, fold: bool = False) -> Column:
    """A list written in one string, as a comparable string without order."""
    parts = F.transform(F.split(c, "[;,]"), lambda x: soft_norm(x, fold))
    return F.array_join(F.array_sort(F.filter(parts, lambda x: x != "")), " ")


def score_norm(c: Column) -> Column:
    """Folded to a-z, digits and single spaces; all marks are dropped."""
    low = F.lower(F.translate(c, *SCORE_FOLD))
    return F.trim(F.regexp_replace(strip_marks(low), "[^a-z0-9]+", " "))


def token_norm(c: Column) -> Column:
    """For token metrics: repaired, lowered, folded, punctuation as spaces."""
    low = F.translate(turkish_lower(_translate(c, SHORT_GLYPHS)), *TURKISH_FOLD)
    return F.trim(F.regexp_replace(low, NON_WORD + "+", " "))


def bibliography_norm(c: Column) -> Column:
    low = F.translate(F.lower(c), *BIBLIOGRAPHY_FOLD)
    return F.trim(F.regexp_replace(low, "[^0-9a-zà-ÿ]+", " "))


def turkish_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def heading_lower(c: Column) -> Column:
    """Lower case by a table first; what the table names is not lowered again."""
    return F.lower(_translate(c, HEADING_LOWER))


def heading_norm(c: Column) -> Column:
    """A heading without its number; a lowered Roman I may have lost its dot."""
    return F.trim(F.regexp_replace(F.trim(heading_lower(c)), r"^[iıvxlcdm0-9]{1,4}[.)]?\s*", ""))


def mojibake_fix(c: Column) -> Column:
    return _translate(c, MOJIBAKE)


def mojibake_count(c: Column) -> Column:
    """How many characters mojibake_fix changes."""
    return F.length(c) - F.length(F.translate(c, "".join(MOJIBAKE), ""))


def alnum_ascii(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def join_hyphens(c: Column) -> Column:
    """Words cut at a line end are joined."""
    return F.regexp_replace(c, r"-(<lb/>|\s)+", "")


def escape_markup(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_markup(c: Column) -> Column:
    """The ampersand first: doubly escaped markup is undone twice."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    """Markup removed, line breaks <lb/> kept."""
    return F.regexp_replace(c, r"<(?!lb\b)[^>]*>", "")


def strip_all_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]*>", " "))


def clean_doi(c: Column) -> Column:
    low = F.trim(F.lower(c))
    return F.regexp_replace(F.regexp_replace(low, r"^(https?://)?(dx\.)?doi\.org/", ""), r"^doi:\s*", "")


def year_of(c: Column) -> Column:
    """The first year 19xx or 20xx, or an empty string."""
    return F.regexp_extract(c, r"\b(19|20)\d{2}\b", 0)


def drop_title_names(names: Column) -> Column:
    """A list of names without those made of academic titles only."""
    titles = F.array(*map(F.lit, ACADEMIC_TITLES))

    def is_name(n: Column) -> Column:
        words = F.transform(F.split(n, r"\s+"), lambda w: F.lower(F.regexp_replace(w, "^[.,;:]+|[.,;:]+$", "")))
        words = F.filter(words, lambda w: w != "")
        return (n != "") & ((F.size(words) == 0) | (F.size(F.array_except(words, titles)) > 0))

    return F.filter(names, is_name)


def crlf_to_lf(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


#: Letters and digits of a word, and how many characters of a batch are looked at in one go.
WORD_LETTERS = string.ascii_letters + string.digits + "ığüşöçİĞÜŞÖÇ"
WORD_CHUNK = 1 << 20
_letters = np.zeros(1 << 16, bool)
_letters[[ord(c) for c in WORD_LETTERS]] = True


def _word_spans(texts: list[str | None]) -> pa.Array:
    """Words of a few texts: flat arrays of words and places, and where each text's begin."""
    size = np.array([len(t) + 1 for t in texts if t is not None], np.int64)
    begins = np.cumsum(size) - size
    joined = "\n".join([t for t in texts if t is not None]) + "\n"  # no word goes on over a line end
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters[np.minimum(code, len(_letters) - 1)]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    owner = np.searchsorted(begins, start, "right") - 1
    width = np.concatenate([[0], np.cumsum(np.where(code[inside] < 128, 1, 2))])  # bytes of the letters so far
    ends = width[np.concatenate([[0], np.cumsum(end - start)])].astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(code[inside].tobytes().decode("utf-32-le").encode())])
    base = begins[owner] if len(start) else start
    spans = pa.StructArray.from_arrays([words, pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["word", "start", "end"])
    counts, at, k = np.bincount(owner, minlength=len(size)) if len(start) else np.zeros(len(size), np.int64), [0], 0
    for t in texts:
        at.append(at[-1] + (0 if t is None else int(counts[k])))
        k += t is not None
    mask = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans, mask=mask)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def word_spans(s: pa.Array) -> pa.Array:
    """Words of Latin and Turkish letters and digits with their places, in code points."""
    found, texts, held = [], [], 0
    for t in s:
        texts.append(t.as_py())
        held += len(texts[-1] or "")
        if held >= WORD_CHUNK:
            found.append(_word_spans(texts))
            texts, held = [], 0
    return pa.concat_arrays([*found, _word_spans(texts)]) if texts or not found else pa.concat_arrays(found)


def unescape_entities(text: str) -> str:
    return html.unescape(text)
