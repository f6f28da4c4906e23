"""Quality rules as weak supervision (operator 9, DataFrame functions only).

Every rule votes good (1), bad (-1) or abstains (0), and votes only on evidence:
that nothing is broken in one respect says little of the others, so most rules
can only object. Good votes are for what broken texts lack: words of letters and
sentences. Expectation-maximisation estimates from the rules' agreement how far
each can be trusted, at least to FLOOR, and a document stays if its posterior
probability of good quality reaches the threshold. No rule alone rejects a
document, but for the two base limits, which no rule repeats.

Defined cases: a null or empty text has no words and fails the base limits;
repeated rows each get their own row; rows with a null id are scored like
others; other columns, whatever their names, pass through. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import SPACE, let, total, whole_text, words_of
from revsift.llm.em import fit_votes

WINDOW = 8
FLOOR = 0.65  # a rule that votes is right at least so often
VOTERS = ["v_word_length", "v_symbols", "v_symbol_words", "v_plain_words", "v_letters", "v_lines", "v_repeats", "v_capitals", "v_marks", "v_sentences"]
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letters", "n_marks", "n_ends", "n_lines", "n_plain_words", "n_symbol_words"]
PLAIN = r"^\p{Ps}?[\p{L}\p{N}\p{M}]+(['’-][\p{L}\p{N}\p{M}]+)*[.,;:!?)\]\"”]{0,3}$"  # a word or number, with ordinary marks around it


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more in the list, the first one included."""

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            found = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(e["h"])))
            return let(F.sort_array(F.transform(found, lambda e: e["i"])), lambda p: total(
                F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(window)), F.lit(window)))))

        return let(ranked, twice)

    def of_windows(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) <= window, 0).otherwise(let(hashes, of_windows))

    return let(words, of_words)


def facts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts the rules look at, in one struct column ``_facts``."""
    text = whole_text(text_col)

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        n = F.length(t)
        return let(words_of(t), lambda w: let(lines, lambda ln: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
            (n - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
            F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
            (n - F.length(F.translate(t, "!?", ""))).cast("long").alias("n_marks"),
            (n - F.length(F.translate(t, ".!?:;", ""))).cast("long").alias("n_ends"),
            F.size(ln).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda x: x.rlike(PLAIN))).cast("long").alias("n_plain_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&|<>]"))).cast("long").alias("n_symbol_words"))))

    return docs.withColumn("_facts", let(text, of_text))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, over the columns of FACTS. On a document without words they say nothing."""
    n, some = F.col("n_words"), F.col("n_words") > 0
    per_word = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    per_letter = lambda c: F.col(c) / F.greatest(F.col("n_letters"), F.lit(1))
    mean, letters = per_word("word_chars"), F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    said = {
        "v_word_length": _vote(some & ~mean.between(3, 10)),
        "v_symbols": _vote(per_word("n_symbols") > 0.1),
        "v_symbol_words": _vote(per_word("n_symbol_words") > 0.1),
        "v_plain_words": _vote(some & (per_word("n_plain_words") < 0.75), some & (per_word("n_plain_words") > 0.9)),
        "v_letters": _vote(some & (letters < 0.8), letters > 0.9),
        "v_lines": _vote(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        "v_repeats": _vote(per_word("n_repeat_words") > 0.15),
        "v_capitals": _vote((F.col("n_letters") >= 20) & (per_letter("n_capitals") > 0.5)),
        "v_marks": _vote(per_word("n_marks") > 0.3),
        "v_sentences": _vote((n >= 50) & (F.col("n_ends") == 0), some & per_word("n_ends").between(0.02, 0.3)),
    }
    assert list(said) == VOTERS
    return said


def judge_quality(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, the posterior ``quality`` and ``kept``.

    Columns of ``docs`` with these names, or with the voters' names, are replaced."""
    from revsift.llm.common import written

    rest = [c for c in docs.columns if c not in {*FACTS, *VOTERS, "_facts", "base_failed", "quality", "kept"}]
    counted = facts(docs.select(*rest), text_col)
    # the counts are written once; what is kept of the text here is nothing
    lean = written(counted.select(*[c for c in rest if c != text_col], *[F.col("_facts")[c].alias(c) for c in FACTS]), "quality")
    voted = lean.withColumns(votes())
    model = fit_votes(voted, VOTERS, floor=FLOOR)
    n = F.col("n_words")
    failed = (n < 20) | (F.col("n_repeat_words") * 100 > n * 30)
    return (voted.withColumn("quality", F.expr(model.posterior()))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))
