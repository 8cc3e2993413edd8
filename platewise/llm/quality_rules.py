"""Quality rules: a threshold table compiled into one projection over the texts.

A rule compares one measure of a text with a share of another (or with a number) in whole-number arithmetic. The table
of rules becomes one boolean expression per rule; measures and rules are DataFrame expressions evaluated side by side in
one narrow stage: no user functions, no shuffle, no statistics of other documents.

Words are runs of anything but space and \\t to \\r. Lines are the pieces between \\n that hold a word. A window is five
words in a row; windows are put in order by hash, and those that share a hash with a neighbour are put in order by their
words, so that hashes never decide. Null and empty texts have no words (and fail ``few_words``). Rows are judged one by
one: repeated rows, ties and null keys stay as they are. A text is looked at whole; its windows take memory in
proportion to it, in one task. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import BLANKS, whole_text

WINDOW = 5
_BLANK = r"[\x20\x09-\x0D]"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the", "and", "of", "to", "a", "in", "is", "that", "it", "was", "for", "on", "with", "as", "be", "by", "are", "this", "at", "from",
    "de", "la", "et", "le", "les", "des", "en", "du", "un", "une", "que", "pour", "est", "qui", "dans", "par", "sur", "pas", "avec", "au",
    "der", "die", "und", "den", "von", "das", "zu", "mit", "sich", "für", "nicht", "auf", "ist", "dem", "im", "ein", "eine", "als",
    "el", "las", "y", "los", "se", "del", "no", "con", "por", "para", "su", "al", "lo", "como", "más",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if 100 * ``measure`` is ``below`` or ``above`` so many per cent of ``of`` (None: of 1).

    Only texts of at least ``words`` words are held to it. ``base`` rules are reported together as ``base_failed``.
    """

    name: str
    measure: str
    of: str | None = None
    below: int | None = None
    above: int | None = None
    words: int = 0
    base: bool = False


RULES = (
    Rule("few_words", "n_words", below=1000, base=True),
    Rule("repeated_words", "n_repeat_words", of="n_words", above=20, base=True),
    Rule("short_words", "word_chars", of="n_words", below=200),
    Rule("long_words", "word_chars", of="n_words", above=1400),
    Rule("symbols", "n_symbols", of="n_words", above=10),
    Rule("few_stop_words", "n_stop_words", of="n_words", below=1, words=100),
    Rule("repeated_lines", "n_dup_lines", of="n_lines", above=40),
    Rule("bullet_lines", "n_bullet_lines", of="n_lines", above=90, words=50),
    Rule("cut_lines", "n_cut_lines", of="n_lines", above=30, words=50),
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines", "n_repeat_words",
)


def compile_rule(rule: Rule) -> Column:
    """True where a row of measures fails the rule."""
    share = F.col(rule.measure) * 100
    base = F.col(rule.of) if rule.of else F.lit(1)
    fails = F.lit(False)
    if rule.below is not None:
        fails = fails | (share < base * rule.below)
    if rule.above is not None:
        fails = fails | (share > base * rule.above)
    return fails & (F.col("n_words") >= rule.words) if rule.words else fails


def _long(c: Column) -> Column:
    return c.cast("long")


def _beside(rows: Column, k: Column, same) -> Column:
    """Whether the row at ``k`` of an ordered array equals one of its neighbours, as ``same`` compares them."""
    here = F.get(rows, k)
    return F.coalesce(same(here, F.get(rows, k - 1)), F.lit(False)) | F.coalesce(same(here, F.get(rows, k + 1)), F.lit(False))


def _repeated_positions(texts: DataFrame) -> DataFrame:
    """Adds ``_starts``: the ordered starts of the windows of ``_words`` that occur twice or more."""
    last = F.size("_words") - (WINDOW - 1)
    numbered = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.struct(F.xxhash64(F.slice("_words", i, WINDOW)).alias("h"), i.alias("i")),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = texts.withColumn("_order", F.when(last >= 2, F.sort_array(numbered)).otherwise(none))
    alike = F.filter("_order", lambda w, k: _beside(F.col("_order"), k, lambda a, b: a["h"] == b["h"]))
    out = out.withColumn("_alike", alike)
    spelled = F.transform("_alike", lambda w: F.struct(F.slice("_words", w["i"], WINDOW).alias("g"), w["i"].alias("i")))
    out = out.withColumn("_spelled", F.sort_array(spelled))
    equal = F.filter("_spelled", lambda w, k: _beside(F.col("_spelled"), k, lambda a, b: a["g"] == b["g"]))
    return out.withColumn("_starts", F.sort_array(F.transform(equal, lambda w: w["i"])))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The key and ``MEASURES`` (all long) of every text."""
    texts = docs.select(F.col(key), whole_text(text).alias("_text"))
    trimmed = F.btrim("_text", F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{_BLANK}+"))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    texts = _repeated_positions(texts.withColumn("_words", words).withColumn("_lines", lines))
    # A window covers what the next one doesn't.
    covered = F.transform("_starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_starts"), k + 1) - s, F.lit(WINDOW))))
    stops = F.filter("_words", lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))).isin(*stop_words))
    return texts.select(
        F.col(key),
        _long(F.size("_words")).alias("n_words"),
        _long(F.char_length(F.array_join("_words", ""))).alias("word_chars"),
        _long(F.regexp_count("_text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        _long(F.size(stops)).alias("n_stop_words"),
        _long(F.size("_lines")).alias("n_lines"),
        _long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _long(F.size(F.filter("_lines", lambda x: F.btrim(x, F.lit(BLANKS)).rlike("^[-*•]")))).alias("n_bullet_lines"),
        _long(F.size(F.filter("_lines", lambda x: F.btrim(x, F.lit(BLANKS)).rlike(r"(\.\.\.|…)$")))).alias("n_cut_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda total, c: total + c).alias("n_repeat_words"),
    )


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, all measures, ``failed`` (names of the rules a text fails, in table order), ``base_failed`` and ``kept``."""
    measured = measure(docs, key, text)
    names = F.array_compact(F.array(*[F.when(compile_rule(r), F.lit(r.name)) for r in rules]))
    base = [compile_rule(r) for r in rules if r.base]
    any_base = F.array_contains(F.array(*base), True) if base else F.lit(False)
    judged = measured.withColumn("failed", names).withColumn("base_failed", any_base)
    return judged.withColumn("kept", F.size("failed") == 0)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass all rules, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_body"))
    return judge(rows, rules, "_row", "_body").where("kept").select("_row.*")
