"""Aspect sentiment by clause, as array functions over one text Column.

A text that holds no keyword at all has no aspects. Clauses that mention an
aspect are folded in order: phrases count 2, whole words 1, negations shift the
totals, and a fixed-problem phrase takes 3 off the running negative total, never
below 0, which is why the fold is ordered. A lie-punchline inverts the outcome."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import aspect_data as A
from . import rules_data as R
from .text import clauses, contains_any, let

W, D = r"[\p{L}\p{N}_]", "[ऀ-ॿ]"
# Negation and fixed-problem patterns.
NOT_GOOD = r"\b(not|never|no|hardly|scarcely)\s+(good|clean|fast|smooth|worth|impressive|responsive)\b|(?:चांगला|चांगली|चांगले|छान|मस्त|अच्छा|बढ़िया)\s+(?:नाही|नाहीत|नहीं)|(?:नाही|नहीं)\s+(?:चांगला|चांगली|अच्छा|छान)"
NOT_BAD = r"\b(not|never|no)\s+(bad|broken|slow|crash|glitch|terrible|disaster)\b|(?:वाईट|खराब)\s+(?:नाही|नहीं)"
REPAIRED = r"\b(fixed|resolved|eliminated|no|zero|gayab)\s+.*(bug|bugs|glitch|glitches|crash|crashes|lag|issue|issues|leak|leaks)\b|\b(bug|bugs|glitch|glitches|crash|crashes|lag|issue|issues|leak|leaks)\s+(gayab|fixed|resolved|eliminated|gone)\b|(?:बग|बग्स|समस्या)\s+(?:नाहीत|नाही|मिटले|दूर\s+झाले)"
REVERSAL = R.PUNCHLINE[0]
NAMES = list(A.ASPECTS)


def keyword_pattern(aspect: str) -> str:
    devanagari = [k for k in A.ASPECTS[aspect] if re.search(D, k)]
    latin = [k for k in A.ASPECTS[aspect] if not re.search(D, k)]
    edge = "[\\p{L}\\p{N}_ऀ-ॿ]"
    return "(?iu)" + f"(?<!{W})(?:" + "|".join(map(re.escape, latin)) + f")(?!{W})" + (f"|(?<!{edge})(?:" + "|".join(devanagari) + f")(?!{edge})" if devanagari else "")


def clause_scores(clause: Column) -> tuple[Column, Column]:
    """Positive and negative signal score of one clause: whole words 1, contained phrases 2."""
    words = F.array_distinct(F.regexp_extract_all(clause, F.lit(rf"{D}+|{W}+(?:-{W}+)?"), 0))

    def score(signals: list[str]) -> Column:
        single = [x for x in signals if " " not in x]
        phrases = F.array(*[F.lit(x) for x in signals if " " in x])
        return F.size(F.filter(words, lambda w: w.isin(single))) + 2 * F.size(F.filter(phrases, lambda p: F.contains(clause, p)))

    return score(A.POSITIVE), score(A.NEGATIVE)


def reversal(text: Column) -> Column:
    return F.lower(text).rlike("(?iu)" + REVERSAL)


#: All keywords: a clause without any of them as a substring mentions no aspect.
KEYWORDS = list(dict.fromkeys(k for ks in A.ASPECTS.values() for k in ks))
# Words without which the negation and fixed-problem patterns cannot match.
SHIFTS = ["not", "never", "no", "hardly", "scarcely", "नाही", "नहीं", "नाहीत", "fixed", "resolved", "eliminated", "zero", "gayab", "gone", "मिटले", "दूर"]


def clause_table(text: Column) -> Column:
    """Array of (clause, p, g, fixed, names) of the clauses that mention an aspect: signals with
    negation shifts, whether a problem is repaired, and the aspects."""
    own = F.filter(clauses(text), lambda c: contains_any(c, KEYWORDS))

    def one(c: Column) -> Column:
        p, g = clause_scores(c)
        shifted = contains_any(c, SHIFTS)
        fixed = shifted & c.rlike("(?iu)" + REPAIRED)
        p = p + F.when(shifted & c.rlike("(?iu)" + NOT_BAD), 1).otherwise(0) + F.when(fixed, 3).otherwise(0)
        g = g + F.when(shifted & c.rlike("(?iu)" + NOT_GOOD), 2).otherwise(0)
        names = F.array(*[F.when(contains_any(c, A.ASPECTS[a]) & c.rlike(keyword_pattern(a)), F.lit(a)) for a in NAMES])
        return F.struct(p.alias("p"), g.alias("g"), fixed.alias("fixed"), names.alias("names"))

    return F.transform(own, one)


def aspect_of(table: Column, reverse: Column, aspect: str) -> Column:
    """positive, negative, neutral, or null where no clause mentions the aspect."""
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("g"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        g = acc["g"] + c["g"]
        more = F.struct((acc["p"] + c["p"]).alias("p"), F.when(c["fixed"], F.greatest(F.lit(0), g - 3)).otherwise(g).alias("g"), (acc["n"] + 1).alias("n"))
        return F.when(F.array_contains(c["names"], aspect), more).otherwise(acc)

    def decided(t: Column) -> Column:
        d = t["p"] - t["g"]
        plain = F.when(d > 0, "positive").when(d < 0, "negative").otherwise("neutral")
        turned = F.when(d > 0, "negative").when(d < 0, "positive").otherwise("negative")
        return F.when(t["n"] > 0, F.when(reverse, turned).otherwise(plain))

    return F.when(F.size(table) > 0, F.aggregate(table, start, step, decided))


def with_aspects(df, text: str = "text"):
    """``df`` with one column aspect_<name> each, n_good and n_bad."""
    t = F.coalesce(F.col(text), F.lit(""))
    # most texts hold no keyword at all and stop here
    some = let(F.lower(t), lambda low: contains_any(low, KEYWORDS))
    x = df.withColumn("_clauses", F.when(some, clause_table(t))).withColumn("_turn", F.when(F.size("_clauses") > 0, reversal(t)))
    for a in NAMES:
        x = x.withColumn(f"aspect_{a}", aspect_of(F.col("_clauses"), F.col("_turn"), a))
    count = lambda v: sum((F.when(F.col(f"aspect_{a}") == v, 1).otherwise(0) for a in NAMES), F.lit(0))
    return x.withColumn("n_good", count("positive")).withColumn("n_bad", count("negative")).drop("_clauses", "_turn")
