"""Column expressions for parsing and normalising text.

Everything here returns a Column built from Spark built-ins. ``fold_ascii`` needs
Unicode NFKD, for which Spark has no function: it goes by tables that the driver
makes from Python's Unicode data.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import defaults as D

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being evaluated)
# ---------------------------------------------------------------------------
# Probability pattern used on model answers, exactly as written (the
# alternation is not grouped, so "10" parses as 0 and "11" as 1).
PROB_PATTERN_AS_WRITTEN = r"\b0\.\d+|1\.0|0|1\b"
# Binary relevance pattern, as written.
BINARY_PATTERN_AS_WRITTEN = r"\b([01])\b"
# Line terminators recognised by Python's str.splitlines().
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
# Code-fence markers removed before JSON parsing.
FENCE_OPEN = "```json"
FENCE = "```"
# ---------------------------------------------------------------------------

# Python's \b separates [\p{L}\p{N}_] from the rest (str.isalnum() counts "²"
# and "½"); Java's \b only counts letters and decimal digits. Each \b of the
# patterns above sits next to a digit, so it is written as a look-behind /
# look-ahead on Python's word class to give the same matches in Java.
_PY_WORD = r"[\p{L}\p{N}_]"
# Python's \d is any decimal digit (Unicode Nd), and float() reads them all.
PROB_PATTERN = rf"(?<!{_PY_WORD})0\.\p{{Nd}}+|1\.0|0|1(?!{_PY_WORD})"
BINARY_PATTERN = rf"(?<!{_PY_WORD})([01])(?!{_PY_WORD})"

# White space as Python's str.strip() / str.isspace() see it (fixed values):
# TAB LF VT FF CR, U+001C..U+001F, SPACE, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = ("[\\t\\n\\x{0b}\\x{0c}\\r\\x{1c}-\\x{1f} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
            "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
_LEADING_TRAILING_WS = "^" + WS_CLASS + "+|" + WS_CLASS + "+$"
_WS_LIST = list(WS_CHARS)
_NON_ASCII = r"[^\x{00}-\x{7f}]"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Strip leading and trailing white space (Python ``str.strip()``).

    The regular expression only runs when the first or last character is
    white space, which keeps the common case to two substring tests."""
    x = col_of(c)
    edge = F.substring(x, 1, 1).isin(*_WS_LIST) | F.substring(x, -1, 1).isin(*_WS_LIST)
    return F.when(edge, F.regexp_replace(x, _LEADING_TRAILING_WS, "")).otherwise(x)


@functools.lru_cache(maxsize=1)
def _decimal_digit_table():
    """Non-ASCII decimal digits (Unicode Nd) and their ASCII values, from unicodedata."""
    src, dst = [], []
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if unicodedata.category(ch) == "Nd":
            src.append(ch)
            dst.append(str(unicodedata.digit(ch)))
    return "".join(src), "".join(dst)



def parse_probability(c) -> Column:
    """First match of PROB_PATTERN in the stripped text as a double, else NULL."""
    hit = F.regexp_extract(trim_ws(c), PROB_PATTERN, 0)
    nd_from, nd_to = _decimal_digit_table()  # built on first use (driver side only)
    return F.nullif(F.translate(hit, nd_from, nd_to), F.lit("")).try_cast("double")


def parse_binary(c) -> Column:
    """First standalone 0 or 1 as an int, else NULL."""
    hit = F.regexp_extract(col_of(c), BINARY_PATTERN, 1)
    return F.nullif(hit, F.lit("")).try_cast("int")


def strip_fences(c) -> Column:
    """Remove ```json and ``` markers, then surrounding white space."""
    inner = F.replace(F.replace(trim_ws(c), F.lit(FENCE_OPEN), F.lit("")), F.lit(FENCE), F.lit(""))
    return trim_ws(inner)


def safe_parse_json(c) -> Column:
    """Fence-stripped text parsed to VARIANT; NULL when it is not valid JSON."""
    return F.try_parse_json(strip_fences(c))


def normalize_line_breaks(c) -> Column:
    """Every splitlines() terminator replaced by a single newline."""
    return F.regexp_replace(col_of(c), LINE_BREAK_PATTERN, "\n")


def split_lines(c) -> Column:
    """ARRAY<STRING> equal to Python ``str.splitlines()`` (no trailing empty line)."""
    norm = normalize_line_breaks(c)
    body = F.regexp_replace(norm, r"\n\z", "")
    return F.when(F.length(norm) == 0, F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one ASCII character, these, and those that fold to several."""
    folds = {}
    for point in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= point < 0xE000:
            folded = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode("ascii")
            if folded:
                folds[chr(point)] = folded
    one = {c: f for c, f in folds.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in folds.items() if len(f) > 1}


def fold_ascii(c) -> Column:
    """NFKD decomposition, then every non-ASCII code point dropped.

    What a character leaves does not depend on its neighbours, so that folding
    goes character by character: ``translate`` for those that leave one, a map
    for the few that leave several, where a value holds any. ASCII values pass."""
    x = col_of(c)
    one, ascii_one, several = _folds()
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in several.items())), F.lit("\x01"), F.lit("\x02"))
    single = F.translate(x, one, ascii_one)
    # tested first for not being ASCII: a class of many characters is slow
    some = r"[\x{80}-\x{10ffff}&&[" + "".join(several) + "]]"
    parts = F.split(single, f"(?={some})|(?<={some})", -1)  # such characters, and what is between them
    long = F.array_join(F.transform(parts, lambda e: F.coalesce(F.try_element_at(table, e), e)), "")
    opened = F.when(x.rlike(some), long).otherwise(single)
    return F.when(x.rlike(_NON_ASCII), F.regexp_replace(opened, _NON_ASCII, "")).otherwise(x)


def clean_ascii(c) -> Column:
    """The JVM part of clean_value, for text that is already ASCII-folded."""
    v = trim_ws(F.lower(col_of(c)))
    v = F.regexp_replace(v, r"[_\-]", " ")
    return F.regexp_replace(v, WS_CLASS + "+", " ")


def clean_value(c) -> Column:
    """Value normalisation used for field comparison.

    NFKD + ASCII folding, lower case, strip, ``_``/``-`` to space, collapse
    white-space runs. The strip happens before the replacement, so ``_a``
    becomes ``" a"``.
    """
    return clean_ascii(fold_ascii(c))


def clean_array(c) -> Column:
    """clean_value of every element of an ARRAY<STRING> (order kept)."""
    return F.transform(col_of(c), clean_value)


def clean_list(c) -> Column:
    """Each element cleaned (NULL element → ``none`` like Python ``str(None)``), sorted."""
    texts = F.transform(col_of(c), lambda x: F.coalesce(x.cast("string"), F.lit("None")))
    return F.array_sort(clean_array(texts))


def normalize_doi(c) -> Column:
    """lower, ``.`` and ``/`` to ``_``, strip; NULL stays NULL."""
    return trim_ws(F.translate(F.lower(col_of(c)), "./", "__"))


def normalize_title(c) -> Column:
    """lower + strip; NULL becomes the empty string."""
    return F.coalesce(trim_ws(F.lower(col_of(c))), F.lit(""))


def token_sort(c) -> Column:
    """Whitespace tokens sorted and joined by one space (Python ``sorted(s.split())``)."""
    stripped = trim_ws(col_of(c))
    toks = F.split(stripped, WS_CLASS + "+", -1)
    return F.when(stripped == "", F.lit("")).otherwise(F.array_join(F.array_sort(toks), " "))


def error_class(c) -> Column:
    """Classify a failure message: rate_limit / network / other (NULL when no error)."""
    raw = col_of(c)
    e = F.lower(raw)
    rate = F.lit(False)
    for i, m in enumerate(D.RATE_LIMIT_MARKERS):
        rate = rate | (raw.contains(m) if i == 0 else e.contains(m))
    net = F.lit(False)
    for m in D.NETWORK_MARKERS:
        net = net | e.contains(m)
    return (F.when(raw.isNull(), F.lit(None).cast("string"))
            .when(rate, F.lit("rate_limit"))
            .when(net, F.lit("network"))
            .otherwise(F.lit("other")))
