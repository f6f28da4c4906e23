"""Document section operators over line arrays.

A document stays one row. Lines come from ``split_lines`` (Python splitlines
semantics); header flags are computed per line with ``transform``; header
positions with ``filter(sequence(...))``; each section is a ``slice`` between
two consecutive header positions. Every step is linear in the document length,
runs inside whole-stage code generation and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, col_of, split_lines, trim_ws

# ---------------------------------------------------------------------------
# Default section lists of the document-cleaning step
# ---------------------------------------------------------------------------
# Sections removed (substring of the lower-cased header); the first header
# containing "references" ends the document.
DEFAULT_DROP = ["references", "acknowledgements", "funding", "appendix", "supplementary",
                "conflict of interest", "funding", "publication", "authors"]
STOP_WORD = "references"
# Sections kept by the keep-list variant (exact match for header detection,
# substring match for selection).
DEFAULT_KEEP = ["introduction", "background", "methods", "methodology", "materials and methods",
                "results", "findings", "discussion", "conclusion", "summary"]
# ---------------------------------------------------------------------------

def header_of_stripped(s: Column) -> Column:
    """header_text for a line that is already stripped (cheap tests first)."""
    md = F.nullif(F.regexp_extract(s, r"^#+" + WS_CLASS + r"+(.*)$", 1), F.lit(""))
    bold = F.nullif(F.regexp_extract(s, r"^\*\*(.+?)\*\*$", 1), F.lit(""))
    alpha = F.when((F.length(s) < 40) & s.rlike(r"^\p{L}{1,39}$"), s)
    h = (F.when(F.startswith(s, F.lit("#")), F.coalesce(md, bold, alpha))
         .when(F.startswith(s, F.lit("**")), F.coalesce(bold, alpha))
         .otherwise(alpha))
    return F.lower(h)


def header_text(line) -> Column:
    """Drop-list header rule: ``#+ text``, ``**text**`` or a letters-only line of
    fewer than 40 characters, on the stripped line; lower-cased text or NULL."""
    return header_of_stripped(trim_ws(line))


def keep_header_of(s: Column, core: Column, keywords: Sequence[str] = DEFAULT_KEEP) -> Column:
    """Keep-list rule on a stripped line ``s`` and its ``*``-stripped core (lazy CASE: cheap tests first)."""
    words = F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, WS_CLASS + "+", -1)))
    upper = (F.upper(core) == core) & (F.lower(core) != core)
    keyword = F.lower(core).isin(*keywords) if keywords else F.lit(False)
    return (F.when(F.startswith(s, F.lit("#")), F.lit(True))
            .when(core.rlike(r"[.:,;]"), F.lit(False))
            .when(words > 5, F.lit(False))
            .otherwise(upper | keyword))


def is_keep_header(line, keywords: Sequence[str] = DEFAULT_KEEP) -> Column:
    """Keep-list header rule: starts with ``#``; else, with ``*`` stripped, at most
    five words, none of ``.:,;``, and upper case or exactly a keyword."""
    s = trim_ws(line)
    return keep_header_of(s, _core(s), keywords)


def _core(s: Column) -> Column:
    return trim_ws(F.regexp_replace(s, r"^\*+|\*+$", ""))


def _header_positions(flags: Column) -> Column:
    """1-based positions i where element_at(flags, i) is true."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(flags), F.lit(1))),
                    lambda i: F.coalesce(F.try_element_at(flags, i), F.lit(False)))


def drop_sections(df: DataFrame, text: str, out: str, drop: Sequence[str] = DEFAULT_DROP,
                  stop: str = STOP_WORD) -> DataFrame:
    """Add ``out``: the text with unwanted sections removed (kept lines joined by newline).

    Intermediate arrays are separate projections so that each is computed once
    per row (an array referenced inside a lambda would otherwise be re-derived
    for every element)."""
    staged = df.withColumn("_lines", split_lines(F.col(text)))
    staged = staged.withColumn("_hdrs", F.transform(F.transform("_lines", trim_ws), header_of_stripped))
    staged = staged.withColumn("_flags", F.transform("_hdrs", lambda h: h.isNotNull()))
    staged = staged.withColumn("_pos", _header_positions(F.col("_flags")))
    lines, hdrs, pos = F.col("_lines"), F.col("_hdrs"), F.col("_pos")
    n = F.size(lines)

    def section(p, j):
        end = F.coalesce(F.try_element_at(pos, j + 2), n + 1)
        return F.struct(F.try_element_at(hdrs, p).alias("h"), F.slice(lines, p, end - p).alias("ls"))

    staged = staged.withColumn("_secs", F.transform(pos, section))
    secs = F.col("_secs")
    first = F.coalesce(F.try_element_at(pos, F.lit(1)), n + 1)
    preamble = F.slice(lines, F.lit(1), first - 1)
    stop_at = F.array_position(F.transform(secs, lambda x: F.instr(x["h"], stop) > 0), True)
    live = F.when(stop_at > 0, F.slice(secs, F.lit(1), stop_at - 1)).otherwise(secs)
    words = F.array(*[F.lit(w) for w in drop])
    kept = F.filter(live, lambda x: ~F.exists(words, lambda w: F.instr(x["h"], w) > 0))
    all_lines = F.concat(preamble, F.flatten(F.transform(kept, lambda x: x["ls"])))
    return staged.withColumn(out, F.array_join(all_lines, "\n")).drop("_lines", "_hdrs", "_flags", "_pos", "_secs")


def build_sections(df: DataFrame, text: str, out: str, keywords: Sequence[str] = DEFAULT_KEEP) -> DataFrame:
    """Add ``out``: ARRAY<STRUCT<header, body>> of the keep-list variant.

    Text before the first header is discarded; a header whose stripped text is
    empty discards its lines; the last header is dropped when no line follows."""
    staged = df.withColumn("_lines", split_lines(F.col(text)))
    staged = staged.withColumn("_s", F.transform("_lines", trim_ws))
    staged = staged.withColumn("_core", F.transform("_s", _core))
    staged = staged.withColumn("_flags", F.zip_with("_s", "_core", lambda a, b: keep_header_of(a, b, keywords)))
    staged = staged.withColumn("_pos", _header_positions(F.col("_flags")))
    lines, pos = F.col("_lines"), F.col("_pos")
    n = F.size(lines)
    k = F.size(pos)

    def section(p, j):
        end = F.coalesce(F.try_element_at(pos, j + 2), n + 1)
        raw = F.try_element_at(lines, p)
        head = trim_ws(F.regexp_replace(raw, r"^[#* ]+|[#* ]+$", ""))
        body = trim_ws(F.array_join(F.slice(lines, p + 1, end - p - 1), "\n"))
        keep = (head != "") & ((j + 1 < k) | (end - p - 1 > 0))
        return F.struct(head.alias("header"), body.alias("body"), keep.alias("_keep"))

    staged = staged.withColumn("_secs", F.transform(pos, section))
    kept = F.filter("_secs", lambda x: x["_keep"])
    res = F.transform(kept, lambda x: F.struct(x["header"].alias("header"), x["body"].alias("body")))
    return staged.withColumn(out, res).drop("_lines", "_s", "_core", "_flags", "_pos", "_secs")


def keep_sections(df: DataFrame, text: str, out: str, keywords: Sequence[str] = DEFAULT_KEEP) -> DataFrame:
    """Add ``out``: sections whose header contains a keyword, as ``## header\\nbody`` joined by a blank line."""
    staged = build_sections(df, text, "_secs2", keywords)
    words = F.array(*[F.lit(w) for w in keywords])
    chosen = F.filter("_secs2", lambda x: F.exists(words, lambda w: F.instr(F.lower(x["header"]), w) > 0))
    joined = F.array_join(F.transform(chosen, lambda x: F.concat(F.lit("## "), x["header"], F.lit("\n"), x["body"])),
                          "\n\n")
    return staged.withColumn(out, joined).drop("_secs2")


def explode_lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line_no, line) rows, line_no 1-based (no shuffle: generator in place)."""
    return df.select(id_col, F.posexplode(split_lines(col_of(text))).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no") + 1)


def header_lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Lines detected as headers by the drop-list rule: (id, line_no, header)."""
    return explode_lines(df, id_col, text).select(id_col, "line_no", header_text(F.col("line")).alias("header")) \
        .where(F.col("header").isNotNull())
