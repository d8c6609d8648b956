"""The decision ladder: rules are data, the first that matches decides.

A rule is (condition, label, confidence, reason). Conditions are small trees
that render both as a Column, over literal patterns that compile once per task,
and as DuckDB SQL for the oracle. Guards are kept apart from patterns, since
some patterns match texts that their guard rejects."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules_data as R
from .text import contains_any, guarded, held, holds, let, needed

# Thread contexts.
DISASTER_CONTEXT = r"\b(outage|offline|crashed|crashing|failed|failing|failure|broken|delay|delayed|incident|emergency|fire|hack|breach|vulnerability|loss|lost|refund|error|layoff|cancelled|canceled|leak|stole|stolen|dropped|unrecoverable|kernel\s+panic|untested|rollback|hung|post-mortem|charged\s+.*by\s+mistake)\b"
TRIUMPH_CONTEXT = r"\b(99\.999%|zero\s+downtime|no\s+downtime|zero\s+customer-facing|zero\s+remediation|soc2\s+type\s+ii|successfully\s+achieved|ahead\s+of\s+.*schedule|delivered\s+all|without\s+a\s+hiccup|successfully\s+processed|10x\s+throughput)\b"
# Praise that a thread context turns or confirms, and lone reactions.
PRAISE_AGAINST = ["brilliant", "great job", "amazing", "love to see it", "genius", "wonderful", "helpful", "huge w", "congrats", "congratulations", "chef's kiss", "10/10", "fantastic", "best update", "clean", "incredible", "phenomenal", "outstanding", "proud", "well done", "stellar", "nothing says enterprise reliability", "enterprise reliability", "keep cooking", "world-class reliability", "looking forward to", "absolute cinema"]
PRAISE_WITH = ["brilliant", "great job", "amazing", "love to see it", "proud", "10/10", "chef's kiss", "huge w", "absolute cinema", "world-class", "could not be happier", "enterprise reliability", "unbelievable"]
ALONE_GOOD = ["w", "peak", "fire", "based", "nocap", "real"]
ALONE_BAD = ["l", "ratio", "ratiod", "cap", "cooked", "mid", "trash"]
CELEBRATION = "[🥳🎉🚀✨💅🍾🥂🏆👏🥰❤️🎈🎊🏖️🍹🤡🎪]"
# Memes.
COOK_BAD = r"\b(bro\s+thought\s+he\s+cooked|who\s+let\s+(?:him|them|bro)\s+cook|never\s+let\s+(?:him|them|bro)\s+cook)\b"
COOK_GOOD = r"\b(let\s+(?:him|them|bro)\s+cook|(?:he|they|bro|devs)\s+cooked)\b"
AURA_BAD = r"(?:aura\s*-\s*\d+|-\s*\d+\s*aura|lost\s+aura|minus\s+aura)"
AURA_GOOD = r"(?:aura\s*\+\s*\d+|\+\s*\d+\s*aura|infinite\s+aura)"
SLANG_VETO = ["क्रैश", "crash", "बग", "bug", "हँग", "hang", "slow", "स्लो"]


#: Every match of the bait-and-switch pattern holds one of these.
BAIT_WORDS = ["prepared", "expect", "would"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Has:
    """Any of the words is a substring of the subject."""

    words: tuple
    subject: str = "low"

    def col(self, env) -> Column:
        return holds(env["held"], self.words)

    def needs(self) -> list[str]:
        return list(self.words)

    def sql(self) -> str:
        return "(" + " OR ".join(f"contains({self.subject}, {_q(w)})" for w in self.words) + ")"


@dataclass(frozen=True)
class Match:
    """Any of the patterns matches the subject."""

    patterns: tuple
    subject: str = "low"
    flags: str = "iu"

    def col(self, env) -> Column:
        if self.subject == "ctx":
            return env["ctx"].rlike(f"(?{self.flags})" + self.pattern)
        return guarded(env[self.subject], env["held"], self.pattern, self.flags)

    @property
    def pattern(self) -> str:
        return "|".join(f"(?:{p})" for p in self.patterns)

    def needs(self) -> list[str]:
        return [] if self.subject == "ctx" else needed(self.pattern)

    def sql(self) -> str:
        bare = [p.replace(r"(?<!not\s)(?<!not\sa\s)", "") for p in self.patterns]
        return f"regexp_matches({self.subject}, {_q('(?i)' + '|'.join(f'(?:{p})' for p in bare))})"


@dataclass(frozen=True)
class Is:
    """A condition that is the same text in both engines."""

    text: str

    def col(self, env) -> Column:
        return env["expr"](self.text)

    def needs(self) -> list[str]:
        return []

    def sql(self) -> str:
        return f"({self.text})"


@dataclass(frozen=True)
class All:
    parts: tuple

    def col(self, env) -> Column:
        out = self.parts[0].col(env)
        for p in self.parts[1:]:
            out = out & p.col(env)
        return out

    def needs(self) -> list[str]:
        return [w for p in self.parts for w in p.needs()]

    def sql(self) -> str:
        return "(" + " AND ".join(p.sql() for p in self.parts) + ")"


@dataclass(frozen=True)
class Not:
    part: object

    def col(self, env) -> Column:
        return ~self.part.col(env)

    def needs(self) -> list[str]:
        return self.part.needs()

    def sql(self) -> str:
        return f"(NOT {self.part.sql()})"


def has(words, subject="low"):
    return Has(tuple(words), subject)


def match(patterns, subject="low", flags="iu"):
    return Match(tuple([patterns] if isinstance(patterns, str) else patterns), subject, flags)


def both(*parts):
    return All(tuple(parts))


#: Trope phrases spared when a negation stands right before them.
_SPARE_BAD = [r"not ", r"not a ", r"wasn't ", r"isn't ", r"neither ", r"expecting a "]
_SPARE_GOOD = [r"not ", r"not a ", r"wasn't ", r"isn't "]


@dataclass(frozen=True)
class Trope:
    """Some trope is in the subject, and none of its negated forms is."""

    words: tuple
    spare: tuple

    def col(self, env) -> Column:
        low = env["low"]

        def plain(w: Column) -> Column:
            spared = F.lit(False)
            for x in self.spare:
                spared = spared | F.contains(low, F.concat(F.lit(x), w))
            return w.isin(*self.words) & ~spared

        return F.exists(env["held"], plain)

    def needs(self) -> list[str]:
        return list(self.words)

    def sql(self) -> str:
        return "(" + " OR ".join(f"(contains(low, {_q(w)}) AND NOT (" + " OR ".join(f"contains(low, {_q(s + w)})" for s in self.spare) + "))" for w in self.words) + ")"


@dataclass(frozen=True)
class Contrast:
    """Opposite polarity words on the two sides of the first comma (after a leading concession) or of the first conjunction."""

    def col(self, env) -> Column:
        low = env["low"]
        pos, neg = (lambda c: contains_any(c, R.CONTRAST_POSITIVE)), (lambda c: contains_any(c, R.CONTRAST_NEGATIVE))

        def clash(a: Column, b: Column) -> Column:
            return (pos(a) & neg(b)) | (neg(a) & pos(b))

        # bound: a split would be made again for every word
        sides = lambda parts: let(parts, lambda p: (F.size(p) > 1) & clash(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
        lead = low.rlike(r"^\s*(while|although|even though|despite|though)")
        return has(R.CONTRAST_WORDS).col(env) & ((lead & sides(F.split(low, ",", 2))) | sides(F.split(low, "(?iu)" + R.CONJUNCTIONS[0], 2)))

    def needs(self) -> list[str]:
        return list(R.CONTRAST_WORDS)

    def sql(self) -> str:
        pos, neg = _q("|".join(map(re.escape, R.CONTRAST_POSITIVE))), _q("|".join(map(re.escape, R.CONTRAST_NEGATIVE)))

        def clash(a, b):
            return f"((regexp_matches({a}, {pos}) AND regexp_matches({b}, {neg})) OR (regexp_matches({a}, {neg}) AND regexp_matches({b}, {pos})))"

        first = f"regexp_extract(low, {_q('(?i)' + R.CONJUNCTIONS[0])})"
        cut = f"strpos(low, {first})"
        left, right = f"substr(low, 1, {cut} - 1)", f"substr(low, {cut} + length({first}))"
        comma = "strpos(low, ',')"
        lead = f"(regexp_matches(low, '^\\s*(while|although|even though|despite|though)') AND {comma} > 0)"
        return f"({has(R.CONTRAST_WORDS).sql()} AND (({lead} AND {clash(f'substr(low, 1, {comma} - 1)', f'substr(low, {comma} + 1)')}) OR ({first} <> '' AND {clash(left, right)})))"


_CTX = Is("coalesce(trim(ctx), '') <> ''")
_TRIUMPH, _DISASTER = match(TRIUMPH_CONTEXT, "ctx"), match(DISASTER_CONTEXT, "ctx")
_BAD_CTX = both(_CTX, Not(_TRIUMPH), _DISASTER)


def _alone(words):
    return Is("alone IN (" + ", ".join(f"'{w}'" for w in words) + ")")


_INDIC = has(R.INDIC_WORDS)
ASPECT_CLASH = Is("n_good > 0 AND n_bad > 0")
# Labels, confidences and reasons, as (id, condition, label, confidence, reason).
LADDER = [
    ("R01", both(_BAD_CTX, has(PRAISE_AGAINST)), "negative", 0.92, "context_mismatch_sarcasm"),
    ("R02", both(_BAD_CTX, Is("base_label = 'negative'")), "negative", "greatest(base_conf, 0.92D)", "context_reinforced_negative"),
    ("R03", both(_CTX, _TRIUMPH, has(PRAISE_WITH)), "positive", 0.92, "context_aligned_praise"),
    ("R04", _alone(ALONE_GOOD), "positive", 0.95, "single_word_reaction_praise"),
    ("R05", _alone(ALONE_BAD), "negative", 0.95, "single_word_reaction_criticism"),
    ("R06", both(has(["cook"]), match(COOK_BAD)), "negative", 0.95, "meme_mockery_cooked"),
    ("R07", both(has(["cook"]), match(COOK_GOOD)), "positive", 0.93, "meme_praise_cooked"),
    ("R08", both(has(["aura"]), match(AURA_BAD)), "negative", 0.95, "meme_loss_of_aura"),
    ("R09", both(has(["aura"]), match(AURA_GOOD)), "positive", 0.95, "meme_gain_of_aura"),
    ("R10", has(["skill issue"]), "negative", 0.93, "meme_skill_issue"),
    ("R11", has(["ain't it", "aint it"]), "negative", 0.93, "meme_this_aint_it"),
    ("R12", has(["demure"]), "positive", 0.92, "meme_demure_aesthetic"),
    ("R13", both(has(BAIT_WORDS), match(R.BAIT_SWITCH)), "positive", 0.92, "reverse_bait_and_switch_detected"),
    ("R14", both(has(R.LITOTES_WORDS), match(R.LITOTES_POSITIVE)), "positive", 0.90, "litotes_positive_detected"),
    ("R15", both(has(R.LITOTES_WORDS), match(R.LITOTES_NEGATIVE)), "negative", 0.92, "litotes_negative_detected"),
    ("R16", both(match(r"[^\x00-\x7F]", "raw"), match(CELEBRATION, "raw"), match(R.OUTAGE, "raw")), "negative", 0.92, "emoji_dissonance_sarcasm"),
    ("R17", both(has(R.DOUBLESPEAK_WORDS), match(R.DOUBLESPEAK)), "negative", 0.92, "corporate_doublespeak_detected"),
    ("R18", both(has(R.MOCKERY_WORDS), match(R.MOCKERY)), "negative", 0.92, "rhetorical_mockery_detected"),
    ("R19", both(has(R.PUNCHLINE_WORDS), match(R.PUNCHLINE)), "negative", 0.92, "sarcastic_irony_detected"),
    *[(f"R20{k}", both(has(R.ADVANCED_WORDS), match(p, "raw")), "negative", 0.92, k) for k, p in R.ADVANCED.items()],
    ("R21", both(_INDIC, match(R.INDIC_PRAISE, "raw", "ius")), "negative", 0.93, "indic_sarcastic_praise"),
    ("R22", both(_INDIC, match(R.INDIC_BACKHANDED, "raw", "ius")), "negative", 0.90, "indic_backhanded_compliment"),
    ("R23", both(_INDIC, match(R.CYNICAL, "raw")), "negative", 0.92, "cynical_conditional_irony"),
    ("R24", both(_INDIC, match(R.INDIC_GRATITUDE, "raw", "ius")), "negative", 0.92, "indic_faux_gratitude"),
    ("R25", both(_INDIC, match(R.INDIC_RHETORICAL, "raw")), "negative", 0.92, "indic_rhetorical_mockery"),
    ("R26", both(has(R.INDIC_SLANG_WORDS), match(R.INDIC_SLANG, "raw"), Not(has(SLANG_VETO))), "positive", 0.92, "indic_slang_inversion_praise"),
    ("R27", both(has(R.SLANG_PRAISE_WORDS), match(R.SLANG_PRAISE)), "positive", 0.90, "slang_inversion_praise"),
    ("R28", both(has(R.CONTRONYM_WORDS), match(R.CONTRONYM)), "negative", 0.90, "contronym_negative_detected"),
    ("R29", Contrast(), "mixed", 0.90, "contrastive_clause_mixed"),
    ("R30", Is("(n_good + n_bad) > 0 AND n_good = 0 AND (base_label = 'neutral' OR base_conf < 0.6)"), "negative", 0.88, "unanimous_negative_aspects"),
    ("R31", Is("(n_good + n_bad) > 0 AND n_bad = 0 AND (base_label = 'neutral' OR base_conf < 0.6)"), "positive", 0.88, "unanimous_positive_aspects"),
    ("R32", Trope(tuple(R.DISASTERS), tuple(_SPARE_BAD)), "negative", 0.92, "cultural_disaster_metaphor"),
    ("R33", Trope(tuple(R.TRIUMPHS), tuple(_SPARE_GOOD)), "positive", 0.92, "cultural_triumph_metaphor"),
    ("R34", both(has(R.NEWS_WORDS), match(R.NEWS), Not(match(R.FIRST_PERSON))), "neutral", 0.85, "objective_news_or_listing"),
]
#: Words that the guards and patterns of the ladder look for.
WORDS = [w for _, c, *_ in LADDER for w in c.needs()]
# Marks around a lone reaction.
_ALONE = r"^[#@\s]+|[.!?,\s💀🔥👏🏆]+$"


def decide(df, text="text", context="context", base_label="base_label", base_conf="base_conf", n_good=None, n_bad=None):
    """``df`` with final_label, final_conf, low_confidence and reason. n_good and n_bad are the
    counts of positive and negative aspects; without them the aspect rules never fire."""
    raw = F.coalesce(F.col(text), F.lit(""))
    x = df.withColumn("_raw", raw).withColumn("_low", F.lower("_raw")).withColumn("_ctx", F.lower(F.coalesce(F.col(context), F.lit(""))))
    x = x.withColumn("_alone", F.trim(F.regexp_replace("_low", _ALONE, ""))).withColumn("_good", F.col(n_good) if n_good else F.lit(0)).withColumn("_bad", F.col(n_bad) if n_bad else F.lit(0))
    names = {"alone": "_alone", "ctx": "_ctx", "n_good": "_good", "n_bad": "_bad", "base_label": base_label, "base_conf": base_conf}
    expr = lambda s: F.expr(re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m[1]], s))
    env = {"raw": F.col("_raw"), "low": F.col("_low"), "held": F.col("_held"), "ctx": F.col("_ctx"), "expr": expr}
    x = x.withColumn("_held", held(F.col("_low"), WORDS))
    rules = [(c, lab, conf, why) for _, c, lab, conf, why in LADDER]
    at = next(i for i, r in enumerate(LADDER) if r[0] == "R29")
    rules.insert(at, (ASPECT_CLASH, "mixed", 0.90, "contrastive_clause_mixed"))
    index = F.lit(-1)
    for i, (cond, *_rest) in reversed(list(enumerate(rules))):
        index = F.when(cond.col(env), F.lit(i)).otherwise(index)
    x = x.withColumn("_rule", index)
    pick = lambda k: F.get(F.array(*[F.lit(r[k]) for r in rules]), F.col("_rule"))
    confs = F.get(F.array(*[F.lit(r[2] if not isinstance(r[2], str) else None).cast("double") for r in rules]), F.col("_rule"))
    hit = F.col("_rule") >= 0
    base = F.col(base_conf)
    out = (
        x.withColumn("final_label", F.when(hit, pick(1)).otherwise(F.col(base_label)))
        .withColumn("final_conf", F.when(hit, F.coalesce(confs, F.greatest(base, F.lit(0.92)))).otherwise(base))
        .withColumn("low_confidence", ~hit & (base < 0.6))
        .withColumn("reason", F.when(hit, pick(3)).otherwise("model_inference"))
    )
    return out.drop("_raw", "_low", "_ctx", "_alone", "_good", "_bad", "_rule", "_held")


def ladder_sql(rows: str) -> str:
    """CASE ladder over a relation with raw, low, ctx, alone, base_label, base_conf, without aspects."""
    rules = [r for r in LADDER if r[0] not in ("R30", "R31")]
    lab = " ".join(f"WHEN {c.sql()} THEN {i}" for i, (_, c, *_r) in enumerate(rules))
    labels = "[" + ", ".join(f"'{r[2]}'" for r in rules) + "]"
    confs = "[" + ", ".join("NULL" if isinstance(r[3], str) else f"{r[3]}::DOUBLE" for r in rules) + "]"
    why = "[" + ", ".join(f"'{r[4]}'" for r in rules) + "]"
    return (
        f"SELECT * EXCLUDE (rule), CASE WHEN rule >= 0 THEN {labels}[rule + 1] ELSE base_label END AS final_label, "
        f"CASE WHEN rule < 0 THEN base_conf ELSE coalesce({confs}[rule + 1], greatest(base_conf, 0.92)) END AS final_conf, "
        f"rule < 0 AND base_conf < 0.6 AS low_confidence, CASE WHEN rule >= 0 THEN {why}[rule + 1] ELSE 'model_inference' END AS reason "
        f"FROM (SELECT *, CASE {lab} ELSE -1 END AS rule FROM {rows})"
    )


def subject_sql(text: str = "text", context: str = "context") -> str:
    alone = "'^[#@\\s]+|[.!?,\\s💀🔥👏🏆]+$'"
    return f"coalesce({text}, '') AS raw, lower(coalesce({text}, '')) AS low, lower(coalesce({context}, '')) AS ctx, trim(regexp_replace(lower(coalesce({text}, '')), {alone}, '', 'g'), ' ') AS alone"
