"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule is a Boolean column that is true where a document is rejected. On a
bounded random sample the share that each rule rejects and the time that it
takes are measured; the rules then run in descending order of rejection per cost
inside one CASE expression, whose later branches are not evaluated for a document
that an earlier one rejects. What is asked for anyway is worked out once, before
the cascade; every other count is worked out inside the CASE, where it is
reached. The verdict does not depend on the order.

All of it is built-in functions inside the JVM.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _native

#: Rows of the random sample that orders the rules, about.
SAMPLE_ROWS = 1000
#: Runs of which the fastest is a rule's time, and the least time, in seconds, that two rules may differ by.
REPEATS, LEAST_S = 3, 0.004
#: Counts that a query over all rows returns; rules find them ready.
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS, CAPITALS = "[#*$%&|<>]", "[A-Z]"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def _chars(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match a one-character pattern."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def repeated_words(word: Column, width: int = 5) -> Column:
    """Words that lie in a run of ``width`` words found twice or more, the first included.

    A text whose runs are all distinct, which is most, is settled by one hash set.
    """
    runs = _native.shingle_hashes(word, width)
    return F.when(F.size(word) < width, F.lit(0)).otherwise(_covered(runs, width)).cast("long")


def _covered(runs: Column, width: int) -> Column:
    def ordered(at: Column) -> Column:
        """Words under the runs that ``at`` (hash and place, sorted) has twice."""
        last = F.size(at) - 1
        twice = F.filter(
            at,
            lambda x, i: ((i > 0) & (F.get(at, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(at, i + 1)["h"] == x["h"])),
        )
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(-width).alias("prev"), F.lit(0).alias("sum"))
        return F.aggregate(
            places,
            zero,
            lambda acc, x: F.struct(x.alias("prev"), (acc["sum"] + F.least(F.lit(width), x - acc["prev"])).alias("sum")),
            lambda acc: acc["sum"],
        )

    # bound once as a one-element array, so that the runs are not worked out again for every use
    one = F.transform(
        F.array(runs),
        lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(
            F.element_at(
                F.transform(F.array(F.array_sort(F.transform(r, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), ordered),
                1,
            )
        ),
    )
    return F.element_at(one, 1)


def staged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with the text (null as empty), its words, and its lines that have a word."""
    out = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    out = out.select(*keep, "_text", _native.spaced(F.col("_text")).alias("_spaced"))
    return out.select(*keep, "_text", "_spaced", _native.words(F.col("_spaced")).alias("_words"))


def metrics() -> dict[str, Column]:
    """Counts over ``staged`` columns.

    n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``),
    n_lines (lines with a word), n_dup_lines (those equal to an earlier one),
    n_repeat_words, n_upper (A-Z).
    """
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(F.replace(_native.spaced(line), F.lit(" "), F.lit(""))) > 0)
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.replace("_spaced", F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": _chars(F.col("_text"), SYMBOLS),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_upper": _chars(F.col("_text"), CAPITALS),
    }


def measured(docs: DataFrame, keep: list[str], names: tuple[str, ...] = CONTRACT) -> DataFrame:
    """``staged`` columns and the counts ``names`` of every row; null texts have no words and count 0."""
    return staged(docs, keep).withColumns({n: c for n, c in metrics().items() if n in names})


def base_rules(of: Callable[[str], Column] = F.col) -> list[Rule]:
    """Too few words, or too many of them in repeated runs. ``of`` gives a count by name."""
    return [
        Rule("few_words", of("n_words") < 10),
        Rule("repeated_words", 100 * of("n_repeat_words") > 20 * of("n_words")),
    ]


def default_rules(of: Callable[[str], Column] = F.col) -> list[Rule]:
    """The base rules and four on symbols, repeated lines, word length and capitals."""
    return [
        *base_rules(of),
        Rule("symbols", 100 * of("n_symbols") > 30 * of("n_words")),
        Rule("repeated_lines", (of("n_dup_lines") > 0) & (100 * of("n_dup_lines") > 30 * of("n_lines"))),
        Rule("word_length", (of("word_chars") < 2 * of("n_words")) | (of("word_chars") > 20 * of("n_words"))),
        Rule("capitals", 100 * of("n_upper") > 50 * of("word_chars")),
    ]


def ordered(sample: DataFrame, rules: list[Rule]) -> list[str]:
    """Names of ``rules`` by the share they reject per cost on the sample.

    A rule's cost is its fastest of ``REPEATS`` runs less that of a rule that does
    nothing, rounded to a power of two of ``LEAST_S``, so that the order repeats;
    ties go by name.
    """
    sample.agg(*(F.count_if(r.rejects) for r in rules)).collect()  # the sample is held before anything is timed

    def run(rejects: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(REPEATS):
            began = time.perf_counter()
            share = sample.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("double")).alias("share")).first()["share"] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    idle, _ = run(F.lit(False))
    ranks = []
    for rule in rules:
        took, share = run(rule.rejects)
        cost = 2.0 ** max(0, round(math.log2(max(took - idle, LEAST_S) / LEAST_S)))
        ranks.append((-share / cost, rule.name))
    return [name for _, name in sorted(ranks)]


def cascade(docs: DataFrame, rules: list[Rule], order: list[str]) -> DataFrame:
    """``docs`` with kept (no rule rejects) and failed_rule (the first in ``order`` that does).

    A rule that is null for a row does not reject it. Columns named kept or
    failed_rule are replaced.
    """
    by_name = {r.name: r for r in rules}
    failed = None
    for name in order:
        rejects = F.coalesce(by_name[name].rejects, F.lit(False))
        failed = F.when(rejects, name) if failed is None else failed.when(rejects, name)
    failed = F.lit(None).cast("string") if failed is None else failed
    return docs.withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())


def random_rows(docs: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of ``docs``, each as likely as any other, in one partition."""
    share = rows / max(1, docs.count())
    return (docs if share >= 1 else docs.sample(share, seed)).coalesce(1)


def judge(
    docs: DataFrame,
    rules: Callable[[Callable[[str], Column]], list[Rule]] = default_rules,
    counts: bool = True,
    sample_rows: int = SAMPLE_ROWS,
    order: list[str] | None = None,
) -> DataFrame:
    """doc_id, kept and failed_rule of every row of ``docs``; with ``counts`` those of ``CONTRACT`` and base_failed too.

    ``order`` names the rules in the order in which they run; without it, it is
    measured. Null texts count as empty; repeated rows are each judged; other
    columns are ignored whatever their names; an empty table gives an empty result.
    """
    inline = metrics()
    ready = CONTRACT if counts else ()
    some = rules(lambda name: F.col(name) if name in ready else inline[name])
    if order is None:
        sample = measured(random_rows(docs.select("doc_id", "text"), sample_rows), ["doc_id"], ready).persist()
        try:
            order = ordered(sample, some)
        finally:
            sample.unpersist()
    out = cascade(measured(docs, ["doc_id"], ready), some, order)
    if not counts:
        return out.select("doc_id", "kept", "failed_rule")
    base = F.lit(False)
    for rule in base_rules():
        base = base | rule.rejects
    return out.select("doc_id", *CONTRACT, base.alias("base_failed"), "kept", "failed_rule")
