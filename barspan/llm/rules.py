"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition that rejects a text. Its cost (seconds) and its selectivity (share of texts it
rejects) are measured on a sample; the rules are then chained by rejection per cost, and a text that one
rule rejects is not given to the next. The order changes the time, never the verdict.

Words are runs of characters other than space and \\x09 to \\x0D. Defined cases: a null text is an empty one
and has no words; a text without words fails the base rules. Any columns of the input are kept as they are,
whatever their names; the working columns have names of their own and are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barspan.plans.tables import written

#: Texts on which costs and selectivities are measured.
SAMPLE_ROWS = 2000
MIN_WORDS = 50
#: Up to so many repeated windows, looking each window up among them is cheaper than sorting.
FEW_REPEATS = 64

_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in several places of one expression."""
    return F.transform(F.array(value), use)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != F.lit(""))


def word_chars(ws: Column) -> Column:
    return F.aggregate(ws, F.lit(0).cast("long"), lambda total, w: total + F.char_length(w))


def symbols(text: Column) -> Column:
    return (F.size(F.split(text, r"[#*$%&|<>]", -1)) - F.lit(1)).cast("long")


def lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _neighbours(x: Column) -> Column:
    """Hash of every element with the next one; one element less."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: F.xxhash64(a, b))


def repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    A window's hash is that of its two word pairs. Most texts have no hash twice. Where one comes twice, a few
    repeated hashes are looked up for every window; many are found by sorting hashes together with places.
    A word counts once however many repeated windows hold it: in order of place, each window adds the words
    up to the next repeated one's start, three at most.
    """
    none = F.lit(None).cast("struct<h:bigint,i:int>")

    def twice(ordered: Column) -> Column:
        same = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.when(a == b, a))
        return F.array_distinct(F.filter(same, lambda h: h.isNotNull()))

    def looked_up(hs: Column, repeats: Column) -> Column:
        return F.filter(F.transform(hs, lambda h, i: F.when(F.array_contains(repeats, h), i)), lambda i: i.isNotNull())

    def by_sorting(ordered: Column) -> Column:
        rest = F.greatest(F.size(ordered) - 1, F.lit(0))
        following = F.zip_with(ordered, F.concat(F.slice(ordered, 2, rest), F.array(none)), lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("next")))
        return let(
            following,
            lambda x: F.sort_array(
                F.filter(
                    F.zip_with(x, F.concat(F.array(F.lit(False)), F.transform(F.slice(x, 1, rest), lambda s: s["next"])), lambda s, before: F.when(s["next"] | before, s["i"])),
                    lambda i: i.isNotNull(),
                )
            ),
        )

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)

    def places(hs: Column) -> Column:
        return let(
            let(F.sort_array(hs), twice),
            lambda repeats: F.when(F.size(repeats) <= FEW_REPEATS, looked_up(hs, repeats)).otherwise(
                let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), by_sorting)
            ),
        )

    return let(
        let(_neighbours(ws), _neighbours),
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(places(hs), covered)),
    )


class Facts:
    """What rules look at, as expressions over one text; ``known`` replaces facts that are columns already."""

    def __init__(self, text: Column, **known: Column):
        self.text, self.known = text, known

    def __getattr__(self, name: str) -> Column:
        if name in self.known:
            return self.known[name]
        return {
            "n_words": lambda: F.size(words(self.text)).cast("long"),
            "word_chars": lambda: word_chars(words(self.text)),
            "n_symbols": lambda: symbols(self.text),
        }[name]()


def base_columns(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    return let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            word_chars(ws).alias("word_chars"),
            symbols(text).alias("n_symbols"),
            dup_lines(text).alias("n_dup_lines"),
            repeat_words(ws).alias("n_repeat_words"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """``reject`` gives the condition under which a text is rejected."""

    name: str
    reject: Callable[[Facts], Column]


def _shouting(f: Facts) -> Column:
    """Few of the words have letters other than capitals (numbers, signs and shouting have none)."""
    return F.lit(3) * (F.size(F.split(f.text, r"[\p{Ll}\p{Lo}]+", -1)) - F.lit(1)) < f.n_words


BASE_RULES = [
    Rule("few_words", lambda f: f.n_words < F.lit(MIN_WORDS)),
    Rule("repeated_windows", lambda f: let(words(f.text), lambda ws: F.lit(100) * repeat_words(ws) > F.lit(50) * F.size(ws))),
]
VERDICT_RULES = [
    Rule("symbols", lambda f: F.lit(4) * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: let(lines(f.text), lambda x: F.lit(2) * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    Rule("word_length", lambda f: (f.word_chars < F.lit(2) * f.n_words) | (f.word_chars > F.lit(20) * f.n_words)),
    Rule("no_small_letters", _shouting),
]


def ordered_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected texts per second, measured on about ``sample_rows`` texts."""
    n = docs.count()
    if not n:
        return list(rules)
    text = docs.select(text_or_empty(F.col(text_col)).alias("text"))
    sample = written(text.sample(min(1.0, sample_rows / n), seed=11), "rule-sample")
    rate = {}
    for rule in rules:
        began = time.perf_counter()
        share = sample.agg(F.avg(F.when(rule.reject(Facts(F.col("text"))), 1.0).otherwise(0.0))).first()[0] or 0.0
        rate[rule.name] = share / (time.perf_counter() - began)
    return sorted(rules, key=lambda r: -rate[r.name])


def cascade(rules: list[Rule], facts: Facts) -> Column:
    """True if any rule rejects; a rule is evaluated only if those before it pass."""
    rejected = F.lit(False)
    for rule in reversed(rules):
        rejected = F.when(F.coalesce(rule.reject(facts), F.lit(False)), F.lit(True)).otherwise(rejected)
    return rejected


def passed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule rejects."""
    rules = ordered_rules(docs, BASE_RULES + VERDICT_RULES, text_col)
    return docs.where(~cascade(rules, Facts(text_or_empty(F.col(text_col)))))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row.

    Texts that fail the base rules skip the cascade; its rules use the base counts where they can.
    """
    rules = ordered_rules(docs, VERDICT_RULES, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    # inline() keeps the optimizer from copying the counts into every expression that uses one of them.
    rows = rows.select("doc_id", "text", F.inline(F.array(base_columns(F.col("text")))))
    failed = (F.col("n_words") < F.lit(MIN_WORDS)) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    facts = Facts(F.col("text"), **{n: F.col(n) for n in ("n_words", "word_chars", "n_symbols")})
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(~cascade(rules, facts)).alias("kept"),
    )
