"""Words and shingles as Column expressions, for operators that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space other than the space itself.
OTHER_SPACE = ("\n", "\t", "\r", "\x0b", "\x0c")


def spaced(text: Column) -> Column:
    """``text`` with every ASCII white-space character as a space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in OTHER_SPACE:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(spaced_text: Column) -> Column:
    """The words of ``spaced`` text in order."""
    return F.array_remove(F.split(spaced_text, " "), "")


def shingle_hashes(word: Column, width: int = 5) -> Column:
    """Hash of each run of ``width`` words; a shorter text is one run of all its words, one without words has none."""
    n = F.size(word)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(word, i + k) for k in range(width))))
    none = F.array().cast("array<bigint>")
    return F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(word, n))).otherwise(none)


def shingles(word: Column, width: int = 5) -> Column:
    """The runs of ``width`` words as texts, a space between words; shorter texts as in ``shingle_hashes``."""
    n = F.size(word)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.concat_ws(" ", *(F.get(word, i + k) for k in range(width))))
    return F.when(n >= width, runs).when(n > 0, F.array(F.array_join(word, " "))).otherwise(F.array().cast("array<string>"))


def shingle_hash(shingle: Column, width: int = 5) -> Column:
    """What ``shingle_hashes`` has for a shingle that ``shingles`` gave."""
    word = F.split(shingle, " ")
    return F.when(F.size(word) == width, F.xxhash64(*(F.get(word, F.lit(k)) for k in range(width)))).otherwise(F.xxhash64(word, F.size(word)))
