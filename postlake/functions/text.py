"""Text normalisation as Column functions, in the order clean, Indic, hashtag,
emoji, slang, contractions, negation, lower. Each takes and returns Columns; only NFKD and the
full entity table leave the JVM, in one Arrow UDF that passes plain ASCII through."""

from __future__ import annotations

import html
import re
import re._constants as sre
import unicodedata
from re._parser import parse as sre_parse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: A pattern without matches, for replacements that a guard switches off.
NEVER = "(?!)"
WORD = r"[\p{L}\p{N}_]"
NOT_IN_WORD = rf"(?<!{WORD})", rf"(?!{WORD})"


#: Words of a camel-case tag.
TAG_WORDS = rf"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\p{{N}}|[^\p{{L}}\p{{N}}_]|$)|\p{{N}}+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; plain nesting repeats a Column at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(text: Column, words) -> Column:
    """Whether one of the words is a substring; plain searches, many times faster than one regular alternation."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def needed(pattern: str) -> list[str]:
    """Lower-case words of which every match of the pattern holds one (folded); empty where none are known."""

    def best(seq) -> list[str]:
        found, run = [], ""
        for op, arg in [*seq, (None, None)]:
            if op is sre.LITERAL:
                run += chr(arg).lower()
                continue
            found, run = found + [[run]] * bool(run), ""
            if op is sre.IN and all(o is sre.LITERAL and a > 127 for o, a in arg):
                found.append([chr(a).lower() for _, a in arg])
            elif op is sre.SUBPATTERN:
                found.append(best(arg[3]))
            elif op is sre.BRANCH:
                arms = [best(a) for a in arg[1]]
                found.append([w for a in arms for w in a] if all(arms) else [])
            elif op is sre.MAX_REPEAT and arg[0]:
                found.append(best(arg[2]))
        return max((f for f in found if f), key=lambda f: (min(min(map(len, f)), 6), -len(f)), default=[])

    return list(dict.fromkeys(best(sre_parse(pattern))))


#: Texts that are turned into Python strings at a time.
TEXTS = 256
#: What a pattern that ignores case takes for an ASCII letter, in lower-case text.
FOLDED = str.maketrans({"\u017f": "s", "\u0131": "i", "\u0307": None})


def held(low: Column, words) -> Column:
    """The different words that are substrings of a lower-case text, in one automaton pass whatever their number;
    a word that only the text with ``FOLDED`` letters holds comes with a tilde before it. Null for null."""
    known = sorted(set(words))

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in known:
            machine.add_word(w, w)
        machine.make_automaton()
        found = lambda t: {w for _, w in machine.iter(t)}

        def one(t: str | None) -> list[str] | None:
            if t is None:
                return None
            plain = found(t)
            bare = t if t.isascii() else t.translate(FOLDED)
            return sorted(plain) if bare == t else sorted(plain) + sorted("~" + w for w in found(bare) - plain)

        parts = [pa.array([one(t) for t in texts.slice(i, TEXTS).to_pylist()], pa.list_(pa.string())) for i in range(0, len(texts), TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return run(low)


def holds(found: Column, words, folded: bool = False) -> Column:
    """Whether ``held`` found one of the words, with ``folded`` also in the text with folded letters."""
    wanted = [*words, *("~" + w for w in words)] if folded else list(words)
    return F.exists(found, lambda w: w.isin(wanted))


def guarded(subject: Column, found: Column, pattern: str, flags: str, edge: tuple[str, str] = ("", "")) -> Column:
    """Whether the pattern matches between its edges; it runs only where ``held`` found a word that it needs."""
    words = needed(pattern)
    there = subject.rlike(f"(?{flags})" + edge[0] + pattern + edge[1])
    return holds(found, words, True) & there if words else there


def nfkd_unescape(text: Column) -> Column:
    """NFKD where a code point is beyond 127, then HTML entities where there is an ampersand."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            t = t if t.isascii() else unicodedata.normalize("NFKD", t)
            return html.unescape(t) if "&" in t else t

        return s.map(one)

    return run(text)


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescape_common(text: Column) -> Column:
    """The five common entities, ampersand last."""
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sarcasm_flag(text: Column) -> Column:
    """A keyword is there and one of the marker patterns matches."""
    return let(F.lower(text), lambda low: contains_any(low, L.SARCASM_KEYWORDS)) & text.rlike("(?i)" + "|".join(L.SARCASM_PATTERNS))


def split_hashtags(text: Column) -> Column:
    """#CamelCase_tag becomes its lower-case words, with a space on either side."""
    rest = F.split(text, r"#[A-Za-z0-9_]+", -1)
    tags = F.regexp_extract_all(text, F.lit("#([A-Za-z0-9_]+)"), 1)
    spaced = F.transform(tags, lambda t: F.concat(F.lit(" "), F.lower(F.replace(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))), F.lit(" ")))
    return F.array_join(F.flatten(F.zip_with(rest, spaced, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def strip_url(text: Column) -> Column:
    """Guard in exact case, pattern in any case."""
    guard = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www."))
    return F.when(guard, F.regexp_replace(text, r"(?iU)https?://\S+|www\.\S+", " ")).otherwise(text)


def strip_mention(text: Column) -> Column:
    return F.regexp_replace(text, rf"@{WORD}+", " ")


def collapse(text: Column) -> Column:
    """Three or more of one character become two; newlines stay."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """Markup, links and mentions out, elongation collapsed, sarcasm tag marked, space squashed."""
    bare = collapse(strip_mention(let(strip_html(split_hashtags(text)), strip_url)))
    return squash(F.when(sarcasm_flag(text), mark_sarcasm(bare)).otherwise(bare))


def mark_sarcasm(text: Column) -> Column:
    return F.regexp_replace(text, L.SARCASM_TAG, " _sarcasm_tag_ ")


def split_remaining_hashtags(text: Column) -> Column:
    """Hashtags left after cleaning, cut at case and digit changes; a tag without such parts stays whole."""
    rest = F.split(text, "#[A-Za-z0-9_]+", -1)
    tags = F.regexp_extract_all(text, F.lit("#([A-Za-z0-9_]+)"), 1)
    parts = F.transform(tags, lambda t: let(F.regexp_extract_all(t, F.lit(TAG_WORDS), 0), lambda w: F.concat(F.lit(" "), F.when(F.size(w) > 0, F.array_join(w, " ")).otherwise(t), F.lit(" "))))
    out = F.array_join(F.flatten(F.zip_with(rest, parts, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(F.contains(text, F.lit("#")), out).otherwise(text)


def emoji_polarity(text: Column) -> Column:
    """Sum of weights over non-overlapping matches, longest first."""
    found = F.regexp_extract_all(text, F.lit("|".join(re.escape(e) for e in L.EMOJI_LONGEST)), 0)
    table = F.create_map(*[x for e, (w, *_) in L.EMOJI.items() for x in (F.lit(e), F.lit(w))])
    return F.when(beyond_ascii(text), F.aggregate(found, F.lit(0.0), lambda acc, e: acc + F.element_at(table, e))).otherwise(0.0)


def beyond_ascii(text: Column) -> Column:
    """Whether there is a code point above 127; two lengths tell it."""
    return F.octet_length(text) > F.char_length(text)


def emoji_meaning(text: Column, mode: str = "meaning") -> Column:
    """Every emoji as its meaning, or with mode ``token`` as its name in one word; spaces around."""
    out = text
    for e in L.EMOJI_LONGEST:
        word = L.EMOJI[e][2] if mode == "meaning" else L.EMOJI[e][1]
        out = F.replace(out, F.lit(e), F.lit(f" {word} "))
    return F.when(beyond_ascii(text), out).otherwise(text)


def _edged(term: str) -> str:
    return NOT_IN_WORD[0] + re.escape(term) + NOT_IN_WORD[1]


def slang_polarity(text: Column, table: dict | None = None) -> Column:
    """Weights of phrases and single words, each counted where it stands as whole words in the text."""
    low = F.lower(text)
    total = F.lit(0.0)
    for term, (w, _) in (table or L.SLANG).items():
        total = total + F.regexp_count(low, F.lit(_edged(term))) * F.lit(w)
    return total


def slang_replace(text: Column, table: dict | None = None) -> Column:
    """Phrases longest first, then single words in table order that were in the original text.
    Texts without any of the terms pass by; a term's pattern runs only where the term is."""
    table = table or L.SLANG
    low = F.lower(text)
    phrases = sorted((t for t in table if " " in t), key=len, reverse=True)
    singles = [t for t in table if " " not in t]
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(f"{WORD}+"), 0))

    # one fold over the terms; each brings its pattern, which runs only where the term is
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit("(?iu)" + _edged(t) + ("" if " " in t else "(?!-)")).alias("pattern"), F.lit(f" {table[t][1]} ").alias("by")) for t in phrases + singles])
    here = F.filter(terms, lambda x: F.contains(low, x["term"]) & (F.contains(x["term"], F.lit(" ")) | F.array_contains(words, x["term"])))
    out = F.aggregate(here, text, lambda c, x: F.regexp_replace(c, x["pattern"], x["by"]))
    known = F.exists(words, lambda w: w.isin(singles)) if singles else F.lit(False)
    return F.when(known | contains_any(low, phrases) if phrases else known, out).otherwise(text)


def expand_contractions(text: Column) -> Column:
    out = text
    for a, b in L.CONTRACTIONS.items():
        out = F.regexp_replace(out, "(?iu)" + _edged(a), b)
    return F.when(F.contains(text, F.lit("'")), out).otherwise(text)


def negation_scope(text: Column, window: int = 3) -> Column:
    """After a negation word the next three words get ``not_``; breakers end the scope."""
    toks = F.regexp_extract_all(text, F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_\s]"), 0)
    neg, stop = F.array(*map(F.lit, L.NEGATION_WORDS)), F.array(*map(F.lit, L.SCOPE_BREAKERS))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("left"))

    def step(acc, t):
        low = F.lower(t)
        is_neg, is_stop = F.array_contains(neg, low), F.array_contains(stop, low)
        plain = t.rlike(r"^[\p{L}\p{N}]+$")
        marks = ~is_neg & ~is_stop & (acc["left"] > 0) & plain
        word = F.when(marks, F.concat(F.lit("not_"), t)).otherwise(t)
        left = F.when(is_neg, F.lit(window)).when(is_stop, F.lit(0)).when(marks, acc["left"] - 1).otherwise(acc["left"])
        return F.struct(F.array_append(acc["out"], word).alias("out"), left.alias("left"))

    done = F.aggregate(toks, start, step, lambda acc: acc["out"])
    joined = F.regexp_replace(F.array_join(done, " "), r"\s+([^\p{L}\p{N}_\s])", "$1")
    return F.when(F.exists(toks, lambda t: F.array_contains(neg, F.lower(t))), joined).otherwise(text)


def indic_detect(text: Column) -> Column:
    return text.rlike("[ऀ-ॿ]")


def normalised(df, text: str, out: str = "normalised", table: dict | None = None):
    """``df`` with the whole chain over an already unescaped text column; empty for null or blank.

    Each step is a projection of its own: the optimizer keeps a step apart that is
    used more than once, where one nested Column would repeat it."""
    from . import indic

    t = F.col("_step")
    x = df.withColumn("_step", clean(F.coalesce(F.col(text), F.lit(""))))
    x = indic.normalised(x, "_step", "_step", "_indic").drop("_indic")
    for step in (split_remaining_hashtags, emoji_meaning, lambda c: slang_replace(c, table), expand_contractions, negation_scope):
        x = x.withColumn("_step", step(t))
    return x.withColumn(out, squash(F.lower(t))).drop("_step")


def model_tokens(text: Column) -> Column:
    """Words of the lower-case text after collapsing elongation; Devanagari runs stay whole."""
    return F.regexp_extract_all(collapse(F.lower(text)), F.lit(rf"[ऀ-ॿ]+|{WORD}+"), 0)


def bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))


def pairs(df, words: str):
    """Rows (a, b): neighbouring words of an array column, counted as two columns before any joined string is made."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    x = df.select(F.explode(F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"))).alias("p"))
    return x.select(F.col("p").getField("0").alias("a"), F.col("p").getField("1").alias("b")) if "0" in x.schema["p"].dataType.names else x.select("p.a", "p.b")


def trigrams(words: Column) -> Column:
    """#abc# of words of 4 to 10 characters that do not begin with an underscore."""
    fit = F.filter(words, lambda w: F.char_length(w).between(4, 10) & ~w.startswith("_"))
    return F.flatten(F.transform(fit, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.concat(F.lit("#"), F.substr(w, i, F.lit(3)), F.lit("#")))))


CLAUSE = r"[.,;!?\n।|]|(?<![\p{L}\p{N}_])(?:but|however|although|though|yet|while|on\s+the\s+other\s+hand)(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_ऀ-ॿ])(?:पण|परंतु|तरी|किंतु)(?![\p{L}\p{N}_ऀ-ॿ])"


def clauses(text: Column) -> Column:
    return F.split(F.lower(text), CLAUSE, -1)
