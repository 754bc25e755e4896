"""Quality rules: a threshold table compiled into Spark expressions, with no user functions.

``measures_of`` gives the measures of a text, ``judge`` adds them with the verdict of a threshold table. A null text counts
as empty: no words, every count 0, rejected by the length rule. Repeated rows are judged one by one; other columns pass
through untouched, since everything stands in one struct column whose name the caller chooses.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was with be as this by are at from or an but not have has he she they we you i "
    "le la les de des du et en un une que qui dans pour par sur est au aux avec ce il elle ne pas se plus "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "el los las del y que se por con una para su al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Threshold:
    """``measure`` must lie in [least, most]; a bound of None is open. ``base`` rules fail a text outright."""

    measure: str
    least: float | None = None
    most: float | None = None
    base: bool = False


#: The production table. Ratios are per word, but for the line ratio, which is per line that has a word.
THRESHOLDS = (
    Threshold("n_words", least=20, base=True),
    Threshold("repeat_percent", most=30, base=True),
    Threshold("mean_word_chars", least=2.5, most=12),
    Threshold("symbol_ratio", most=0.1),
    Threshold("stop_word_ratio", least=0.01),
    Threshold("dup_line_ratio", most=0.5),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """How many words the windows cover whose hash comes twice; the sort is only paid where one does."""

    def covered(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (same(x, k - 1) | same(x, k + 1)).alias("twice"))), lambda x: x["twice"])
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")),
            lambda acc: acc["n"],
        )

    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, covered)).otherwise(0)


def measures_of(text: Column) -> Column:
    """Struct of MEASURES (long) of a text. n_repeat_words counts the words that lie in some 8-word window which the text
    holds twice or more; windows are told apart by 64-bit hashes within one text."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")

    def of_words(w: Column) -> Column:
        n = F.size(w)
        hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(WINDOW)))))
        return let(
            lines,
            lambda x: F.struct(
                n.cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                let(hashes, _repeated).cast("long").alias("n_repeat_words"),
                F.size(F.filter(w, lambda v: F.lower(v).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            ),
        )

    return let(words(body), of_words)


def ratios(m: Column) -> dict[str, Column]:
    """The quantities that a table may name, from a struct of measures."""
    at = {k: m[k] for k in MEASURES}
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return at | {
        "repeat_percent": per(100 * at["n_repeat_words"], at["n_words"]),
        "mean_word_chars": per(at["word_chars"], at["n_words"]),
        "symbol_ratio": per(at["n_symbols"], at["n_words"]),
        "stop_word_ratio": per(at["n_stop_words"], at["n_words"]),
        "dup_line_ratio": per(at["n_dup_lines"], at["n_lines"]),
    }


def compile_rules(thresholds: tuple[Threshold, ...], quantities: dict[str, Column]) -> Column:
    """True where every row of the table holds."""
    tests = [test for t in thresholds for test in ((quantities[t.measure] >= t.least,) if t.least is not None else ()) + ((quantities[t.measure] <= t.most,) if t.most is not None else ())]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def judge(df: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS, into: str = "measures") -> DataFrame:
    """Add the struct ``into``: MEASURES, base_failed and kept (never null)."""

    def verdict(m: Column) -> Column:
        q = ratios(m)
        base = compile_rules(tuple(t for t in thresholds if t.base), q)
        rest = compile_rules(tuple(t for t in thresholds if not t.base), q)
        return F.struct(*[m[k].alias(k) for k in MEASURES], (~base).alias("base_failed"), (base & rest).alias("kept"))

    return df.withColumn(into, let(measures_of(F.col(f"`{text}`")), verdict))
