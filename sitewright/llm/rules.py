"""Quality rules as a bitmask ledger: each rule is evaluated once for each document.

``ledger`` writes measurements and one bit a failed rule into a row; ``apply_policy`` turns
the bits into a verdict by a policy's mask, and ``ablation`` counts, for each rule of a
policy, what it alone rejects, by bitwise aggregation. A new policy or an ablation reads the
ledger, never the texts. Everything is a built-in DataFrame expression within one row: no
shuffle, no Python.

Results by case: a null, empty or blank text has no words and fails ``few_words``; a null id
stays null; repeated rows are judged each; other columns are not carried (``keep_good``
keeps them all); an empty table gives an empty result. Two eight-word windows are taken as
equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that splits words, and symbols (fixed by the measures' definition).
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated when it stands twice in a text.
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The text's words (an empty array if it has none)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t-\r]+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a WINDOW of words found twice or more in ``words``."""
    n = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def flagged(p: Column) -> Column:
            last = F.size(p) - 1
            twin = lambda s, i: ((i > 0) & (s["h"] == F.get(p, i - 1)["h"])) | ((i < last) & (s["h"] == F.get(p, i + 1)["h"]))
            return F.array_sort(F.transform(F.filter(p, twin), lambda s: s["at"]))

        reach = lambda at: F.aggregate(F.transform(at, lambda a, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - a, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
        return let(pairs, lambda p: let(flagged(p), reach))

    # Most texts repeat no window: a count of distinct hashes settles those.
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 2, F.lit(0)).otherwise(some).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Each measurement's expression over the whole text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    return {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(F.translate(whole, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")),
    }


@dataclass(frozen=True)
class Rule:
    """A rule's bit, and the condition on the measurements under which it fails."""

    bit: int
    fails: Callable[[], Column]


#: A rule's bit never changes or is used again: old ledgers stay readable.
RULES = {
    "few_words": Rule(0, lambda: F.col("n_words") < 20),
    "repeated_windows": Rule(1, lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    "many_symbols": Rule(2, lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    "upper_case": Rule(3, lambda: 10 * F.col("n_upper") > 3 * F.col("word_chars")),
    "duplicate_lines": Rule(4, lambda: (F.col("n_lines") > 4) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
    "long_words": Rule(5, lambda: F.col("word_chars") > 25 * F.col("n_words")),
}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "prose-1": ("few_words", "repeated_windows", "many_symbols", "upper_case", "duplicate_lines", "long_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_dup_lines", "n_lines", "n_repeat_words")


def mask_of(policy: str) -> int:
    return sum(1 << RULES[r].bit for r in POLICIES[policy])


def ledger(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed``, a bit for each rule that fails."""
    return _entries(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text")))


def _entries(rows: DataFrame) -> DataFrame:
    """The ledger's entries of column ``__text``, beside the other columns."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "__text"]
    rows = rows.select(*kept, "__text", words_of(F.col("__text")).alias("__words"))
    # The measures stand in an array of structs that is exploded once, so the rules read
    # results and the optimizer does not paste the measuring into each of them.
    rows = rows.select(*kept, F.explode(F.array(F.struct(*(m.alias(k) for k, m in measures(F.col("__text")).items())))).alias("m")).select(*kept, "m.*")
    failed = sum((F.when(r.fails(), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES.values()), F.lit(0))
    return rows.select(*kept, *MEASURES, failed.cast("long").alias("failed"))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """A ledger with ``kept``: whether no rule of the policy fails."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects.

    One pass over the ledger; groups are bit patterns, counted before they shuffle.
    """
    mask = mask_of(policy)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r].bit).alias("bit")) for r in POLICIES[policy]))
    one = patterns.select("bits", "n", F.explode(named).alias("r"))
    count = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0)))
    return one.groupBy("r.rule").agg(count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), count(F.col("bits") == F.col("r.bit")).alias("n_only"))


def keep_good(df: DataFrame, policy: str, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose ledger entries a policy keeps, with their columns as they are."""
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).cast("string").alias("__text"))
    return apply_policy(_entries(held), policy).where("kept").select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
