"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` are columns over a text (lengths, symbols, stop words, lines, repeats); ``RULES`` says between
which bounds a ratio of two measures must lie; ``judge`` turns the table into one boolean projection.

Repeats are found inside a row, with no shuffle: the 3-word windows' 64-bit hashes are sorted with their
positions; a window whose neighbour in that order has its hash is a repeat, and each covers its three words.

Results. A null or empty text: all measures are 0, base_failed. Very long texts count whole. Each row has its own
result, whatever other rows hold, null and repeated ids included; an empty table gives no rows. Other columns pass
through and a clashing one gives way to the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.workspace import fresh, quoted

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in a is that for it as with on by this der die das und in zu den ist von mit ein sich auf des le la les de et un une est que dans pour en el los las y del por con se".split()
)


@dataclass(frozen=True)
class Rule:
    """low <= numerator / denominator <= high; without a denominator the measure itself. No bound: None."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 16.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_or_short_lines", "n_lines", "n_words", None, 0.5),
)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines (lines with a word)."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")
    keep = [c for c in docs.columns if c.lower() not in made]
    t, w, ln, h, a, b = fresh(docs.columns + list(made), "__t", "__w", "__ln", "__h", "__a", "__b")
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    step = docs.select(*[F.col(quoted(c)) for c in keep], text.alias(t))
    bare = F.btrim(F.col(t), F.lit(_SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0)
    step = step.select(
        *[F.col(quoted(c)) for c in keep],
        words.alias(w),
        lines.alias(ln),
        F.length(F.translate(t, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counts = {
        "n_words": F.size(w).cast("long"),
        "n_lines": F.size(ln).cast("long"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS, *map(str.capitalize, STOP_WORDS)))).cast("long"),
    }
    n = F.greatest(F.size(w) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.xxhash64(x, y))
    hashes = F.zip_with(pairs, F.slice(w, F.lit(3), n), lambda x, y: F.xxhash64(x, y))
    rest = ["word_chars", "n_symbols"]
    step = step.select(*[F.col(quoted(c)) for c in keep], *rest, *[v.alias(k) for k, v in counts.items()], hashes.alias(h))
    rest += counts
    at = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
    placed = F.sort_array(F.zip_with(h, at, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.select(*[F.col(quoted(c)) for c in keep], *rest, placed.alias(a))
    like = lambda x, k: F.coalesce(x.getField("h") == F.get(a, k).getField("h"), F.lit(False))
    alike = F.filter(a, lambda x, k: like(x, k + 1) | like(x, k - 1))
    again = F.sort_array(F.transform(alike, lambda x: x.getField("i")))
    step = step.select(*[F.col(quoted(c)) for c in keep], *rest, again.alias(b))
    gaps = F.transform(b, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(b, i + 1) - x, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return step.select(*[F.col(quoted(c)) for c in keep], *rest, covered.alias("n_repeat_words"))


def judge(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where all rules hold; a ratio over 0 holds."""
    out = F.lit(True)
    for r in rules:
        x = F.col(r.numerator).cast("double")
        x = x / F.nullif(F.col(r.denominator), F.lit(0)) if r.denominator else x
        for ok in ([x >= r.low] if r.low is not None else []) + ([x <= r.high] if r.high is not None else []):
            out = out & F.coalesce(ok, F.lit(True))
    return out


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with its measures, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = measure(docs.drop("base_failed", "kept"), text_col)
    return out.withColumns({"base_failed": failed, "kept": ~failed & judge(rules)})
