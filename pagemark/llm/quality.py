"""Quality rules: a table of thresholds compiled into one projection.

A rule bounds the ratio of two measures of a text (``measure`` per ``per``, in
thousandths, both ends allowed), or a measure itself if ``per`` is null. The measures are
whole numbers and so are both sides of every comparison, so no rule depends on rounding.
``assess`` turns the table into one expression of built-in functions: the text is cut
into words, lines and runs of letters once, the measures that the rules name are counted,
and every rule becomes two comparisons. There is no user function, nothing is exploded
or shuffled, and the same expression runs on a stream.

Two conditions stand before the table: a text of fewer than ``LEAST_WORDS`` words, and
one with more than ``MOST_REPEATED`` per cent of its words in windows of eight words
that it holds twice or more. Windows are compared by chained 64-bit hashes of their
words; only texts with a window twice are sorted.

The rules may come as a table of columns (rule, measure, per, least, most); ``read_rules``
takes at most ``MAX_RULES`` of it to the driver and refuses a longer one.

Defined results: a null text is measured like an empty one, has no words, and fails; a
ratio to nothing (no line, no run of letters) breaks no rule; ties at a threshold pass;
repeated rows are judged alike; an empty table gives an empty one; a very long text is one
row's work, at about 100 bytes of memory a word while its windows are sorted; columns pass
through as they are, but for one already called like the new column, which is replaced;
``keep`` adds none and replaces none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemark.functions.arrays import let
from pagemark.llm.common import free_name

WORD = r"[^\x20\x09-\x0D]+"
IN_LINE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\x0b\f\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII without its letters; all beyond ASCII counts as a letter.
NO_LETTERS = "".join(map(chr, [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
MAX_RULES = 500

#: Words that running text of the language can hardly do without.
STOP_WORDS = {
    "en": "a and are as at be but by for from in is it not of on or that the this to was with",
    "de": "als auch auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "fr": "au dans de des du en est et il la le les ne par pas pour que qui se sur un une",
    "es": "al como con de del el en es la las lo los no para por que se su un una y",
}


@dataclass(frozen=True)
class Rule:
    """``measure`` per ``per`` must be from ``least`` to ``most`` thousandths; None is no bound."""

    rule: str
    measure: str
    per: str | None = None
    least: int | None = None
    most: int | None = None


#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_500, 12_000),
    Rule("letter_words", "n_letter_words", "n_words", least=700),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("stop_words", "n_stop_words", "n_letter_runs", least=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=300),
)
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_lines",
    "n_bullet_lines", "n_cut_lines", "n_letter_runs", "n_stop_words",
)


def read_rules(table: DataFrame) -> list[Rule]:
    """The rules of a table (rule, measure, per, least, most), in the order of their names."""
    rows = table.select(
        F.col("rule").cast("string").alias("rule"), "measure", "per", F.col("least").cast("long").alias("least"),
        F.col("most").cast("long").alias("most"),
    ).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return sorted((Rule(**r.asDict()) for r in rows), key=lambda r: r.rule)


def _number(items: Column) -> Column:
    return F.size(items).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words are in windows that occur twice or more, the first ones included."""
    zero = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def places(order: Column) -> Column:
            twice = F.filter(order, lambda x, k: (F.get(order, k - 1)["h"] == x["h"]) | (
                F.get(order, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["at"]))

        def total(at: Column) -> Column:
            new = F.transform(at, lambda p, k: F.least(
                F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
            return F.aggregate(new, zero, lambda sum_, n: sum_ + n)

        return let(let(placed, places), total)

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - window)
        return let(
            F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window)))),
            lambda own: F.when(F.size(F.array_distinct(own)) == F.size(own), zero).otherwise(covered(own)),
        )

    return F.when(F.size(words) > window, let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(zero)


def measures(text: Column) -> Column:
    """A struct of all MEASURES of a text."""
    stop = sorted(set(" ".join(STOP_WORDS.values()).split()))
    zero = F.lit(0).cast("long")

    def of_words(words: Column) -> list[Column]:
        return [
            _number(words).alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        ]

    def of_lines(lines: Column) -> list[Column]:
        return [
            (_number(lines) - _number(F.array_distinct(lines))).alias("n_dup_lines"),
            _number(lines).alias("n_lines"),
            _number(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet_lines"),
            _number(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_cut_lines"),
        ]

    def of_runs(runs: Column) -> list[Column]:
        return [_number(runs).alias("n_letter_runs"),
                _number(F.filter(runs, lambda w: w.isin(stop))).alias("n_stop_words")]

    bound = F.coalesce(text, F.lit(""))
    small = F.translate(bound, UPPER + NO_LETTERS, LOWER + " " * len(NO_LETTERS))
    # without what is neither letter nor space, only words with a letter are left
    bare = F.translate(bound, "".join(c for c in NO_LETTERS if c not in SPACE), "")
    parts = [
        let(F.regexp_extract_all(bound, F.lit(WORD), F.lit(0)), lambda w: F.struct(*of_words(w))),
        let(F.filter(F.split(bound, "\n"), lambda x: x.rlike(IN_LINE)), lambda x: F.struct(*of_lines(x))),
        let(F.array_remove(F.split(small, " +"), ""), lambda r: F.struct(*of_runs(r))),
        F.struct(F.regexp_count(bound, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
                 F.regexp_count(bare, F.lit(WORD)).cast("long").alias("n_letter_words")),
    ]
    held = ("n_words word_chars n_repeat_words", "n_dup_lines n_lines n_bullet_lines n_cut_lines",
            "n_letter_runs n_stop_words", "n_symbols n_letter_words")
    place = {name: at for at, names in enumerate(held) for name in names.split()}
    return let(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), lambda all_: F.struct(*(
        F.coalesce(all_[f"p{place[name]}"][name], zero).alias(name) for name in MEASURES)))


def broken(rule: Rule, measured: Column) -> Column:
    """Whether the measures break a rule."""
    for name in filter(None, (rule.measure, rule.per)):
        if name not in MEASURES:
            raise ValueError(f"no such measure: {name}")
    value, base = measured[rule.measure], F.lit(1)
    if rule.per is not None:
        value, base = value * 1000, measured[rule.per]
    out = F.lit(False)
    if rule.least is not None:
        out = out | (value < base * rule.least)
    if rule.most is not None:
        out = out | (value > base * rule.most)
    return out if rule.per is None else out & (base > 0)


def assess(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The compiled table: a struct of the measures, base_failed, failed (names of rules), kept."""
    def judge(m: Column) -> Column:
        base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
        names = [F.when(broken(r, m), F.lit(r.rule)) for r in rules]
        failed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
        return let(failed, lambda f: F.struct(
            *(m[name].alias(name) for name in MEASURES), base.alias("base_failed"), f.alias("failed"),
            (~base & (F.size(f) == 0)).alias("kept"),
        ))

    return let(measures(text), judge)


def apply_rules(documents: DataFrame, rules: Sequence[Rule] = RULES, column: str = "quality") -> DataFrame:
    """All columns, and one with measures and verdict."""
    return documents.withColumn(column, assess(F.col("text"), rules))


def keep(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their columns and nothing else.

    A plain filter on the verdict would have the optimizer copy the whole expression, so
    rejected rows are dropped by a generator over one element or none.
    """
    name = free_name(documents.columns, "verdict")
    verdict = F.filter(F.array(assess(F.col("text"), rules)["kept"]), lambda kept: kept)
    return documents.select("*", F.explode(verdict).alias(name)).drop(name)
