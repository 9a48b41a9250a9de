"""Quality rules: a table of thresholds compiled into one projection.

All measures come from built-in functions over the row's own text, so the plan is
a scan and one projection: no shuffle, no user code, nothing kept between rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, unused

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at from an he or "
    "de la le les des et un une en que du est pas dans pour el los las del se por con su "
    "der die das und den von zu mit ist nicht ein eine auf dem im"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject where the measure lies outside [least, most]; None: no bound on that side."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The base rules: they reject whatever the other rules say.
BASE = (Rule("n_words", least=50), Rule("repeat_word_ratio", most=0.5))
#: The table. Ratios are shares of words, of characters or of lines with a word.
RULES = (
    Rule("mean_word_chars", least=2, most=20),
    Rule("symbol_ratio", most=0.05),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.6),
)


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once: lambda variables aren't evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _repeats(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""

    def covered(hashed: Column) -> Column:
        def marked(s: Column) -> Column:
            def same(x, y):
                return (x["h"] == y["h"]) & (F.get(w, x["i"]) == F.get(w, y["i"])) & (F.get(w, x["i"] + 1) == F.get(w, y["i"] + 1)) & (F.get(w, x["i"] + 2) == F.get(w, y["i"] + 2))

            at = F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"])
            start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(F.sort_array(at), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

        pairs = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0)).otherwise(_bind(pairs, marked))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_bind(windows, covered))


def measures(text: Column) -> Column:
    """All measures of a text as one struct. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    seen = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeats(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop_words"),
        )

    return F.struct(
        _bind(_words(text), of_words).alias("w"),
        _bind(seen, of_lines).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def compiled(rules, named: dict[str, Column]) -> Column:
    """True where some rule rejects."""
    out = F.lit(False)
    for r in rules:
        if r.least is not None:
            out = out | (named[r.measure] < r.least)
        if r.most is not None:
            out = out | (named[r.measure] > r.most)
    return out


def judged(docs: DataFrame, text_col: str = "text", rules=RULES, base=BASE, into: str = "quality") -> DataFrame:
    """docs with one struct column more: the measures, base_failed and kept.

    A null or empty text has no words and fails. Each row is judged by its own text
    alone: null or repeated ids and further columns make no difference. Where `into`
    names a column already there, underscores are added to it.
    """
    into = unused(into, docs.columns)

    def verdict(m: Column) -> Column:
        w, lines = m["w"], m["l"]
        n = w["n_words"]
        named = {
            "n_words": n,
            "repeat_word_ratio": _ratio(w["n_repeat_words"], n),
            "mean_word_chars": _ratio(w["word_chars"], n),
            "symbol_ratio": _ratio(m["n_symbols"], w["word_chars"]),
            "stop_word_ratio": _ratio(w["n_stop_words"], n),
            "dup_line_ratio": _ratio(lines["n_dup_lines"], lines["n_lines"]),
        }
        failed = compiled(base, named)
        longs = {"n_words": n, "word_chars": w["word_chars"], "n_symbols": m["n_symbols"], "n_dup_lines": lines["n_dup_lines"], "n_repeat_words": w["n_repeat_words"], "n_stop_words": w["n_stop_words"]}
        return F.struct(*[c.cast("long").alias(k) for k, c in longs.items()], failed.alias("base_failed"), (~(failed | compiled(rules, named))).alias("kept"))

    return docs.withColumn(into, _bind(measures(docs[f"`{text_col}`"]), verdict))


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns they had."""
    mark = unused("quality", docs.columns)
    return judged(docs, text_col, into=mark).where(F.col(mark)["kept"]).drop(mark)
