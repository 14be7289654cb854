"""Quality rules: a threshold table compiled into Spark projections of native functions.

The text is split once into words and lines; the measures are counts over those arrays, and every rule compares two
counts as ``100 * part > bound * whole``, in integers, so that results are the same on every engine. No rule shuffles
a row: the operator is one scan and a few projections.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.names import inner

WINDOW = 8
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on was at by this from as or are not what "
    "le la les de des du un une et est en que qui dans pour pas sur au avec ce il elle ne "
    "der die das und ein eine ist nicht mit von zu den dem im auf für als auch sich des "
    "el los las una y es por con para del se lo su al no"
).split()


class Rule(NamedTuple):
    """A text fails if ``100 * part`` is above ``bound * whole`` (below, if ``least``), given ``n_words >= from_words``."""

    name: str
    part: str
    whole: str
    bound: int
    least: bool = False
    from_words: int = 0


#: The table: measures are columns of :func:`measures`.
RULES = (
    Rule("words_too_long", "word_chars", "n_words", 1200),
    Rule("words_too_short", "word_chars", "n_words", 200, least=True),
    Rule("symbols", "n_symbols", "n_words", 25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 30),
    Rule("stop_words", "n_stop_words", "n_words", 2, least=True, from_words=50),
)


def _repeat_words(h: str) -> Column:
    """Words inside the windows that occur twice or more, from the column ``h`` of a text's window hashes."""
    at = f"transform({h}, (x, i) -> struct(x AS h, i AS i))"
    again = "(j > 0 AND s[j - 1].h = s[j].h) OR (j + 1 < size(s) AND s[j + 1].h = s[j].h)"
    starts = f"flatten(transform(array(sort_array({at})), s -> transform(filter(sequence(0, size(s) - 1), j -> {again}), j -> s[j].i)))"
    covered = (
        f"aggregate(sort_array({starts}), struct(-{WINDOW} AS last, 0L AS n), "
        f"(a, x) -> struct(x AS last, a.n + least({WINDOW}, x - a.last) AS n), a -> a.n)"
    )
    return F.expr(f"CASE WHEN size({h}) < 2 OR size(array_distinct({h})) = size({h}) THEN 0L ELSE {covered} END")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_bullet_lines, n_ellipsis_lines."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    t, w, lines, x, h = inner(docs, "t", "w", "l", "x", "h")
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(w, F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda word: word != ""))
    df = df.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda line: F.translate(line, " \t\n\x0b\x0c\r", "") != ""))
    df = df.withColumn(x, F.transform(w, lambda word: F.xxhash64(word)))
    hashed = ", ".join(f"{x}[i + {k}]" for k in range(WINDOW))
    df = df.withColumn(
        h,
        F.expr(f"CASE WHEN size({w}) < {WINDOW} THEN array() ELSE transform(sequence(0, size({w}) - {WINDOW}), i -> xxhash64({hashed})) END"),
    )
    cut = F.expr(f"transform({lines}, x -> ltrim(x))")
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(h),
            "n_stop_words": F.expr(f"CAST(size(filter({w}, w -> lower(w) IN ({stop}))) AS BIGINT)"),
            "n_bullet_lines": F.size(F.filter(cut, lambda x: F.substring(x, 1, 1).isin("•", "-", "*"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
        }
    )
    return df.drop(t, w, lines, x, h)


def _fails(rule: Rule) -> Column:
    part, whole = F.lit(100) * F.col(rule.part), F.lit(rule.bound) * F.col(rule.whole)
    over = part < whole if rule.least else part > whole
    return over & (F.col("n_words") >= rule.from_words)


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its measures, ``base_failed``, ``failed_rules`` (names, in the table's order) and ``kept``.

    A null text counts as no text: every count is 0 and the base rule fails it. Columns of ``docs`` that bear a
    measure's name are replaced; the others pass. Repeated rows are judged alike, an empty table gives none.
    """
    df = measures(docs, text)
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    failed = F.filter(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    df = df.withColumn("failed_rules", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
