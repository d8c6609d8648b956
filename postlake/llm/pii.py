r"""Operator 7: personal data by fixed patterns and bootstrapped contexts.

Base spans come from four patterns (email, ip, card, phone), leftmost and not
overlapping within a kind, each match then accepted or dropped for good. They
seed a pattern-instance graph: an occurrence of an identifier-like token gives
edges from its instance to lexical patterns (the word before, the word after,
both with the token's shape). Spark scores the graph in rounds: a pattern's
confidence is the mean score of its distinct instances, an instance's score is
that of its best patterns; seeds score 1. Patterns that enough distinct seeds
support with high confidence then mark unseen identifiers of the same shape,
as spans of kind ``other`` after the base kinds; they never replace base spans.
Long random-looking strings (32 or more letters and digits, eight of each at
least) are seeds too, and spans of kind ``secret``.

One pass over the texts writes a small table (row id, counts, base spans,
candidate tokens with their patterns) to the shared folder; all graph work runs
on that table. Frequent patterns are summed before shuffling, and a pattern's
occurrences are never gathered. Null and empty texts have no spans; repeated
rows are handled apart by row id and get equal results; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches in linear time: one can begin only where a run of digits begins.
IP_RUN = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifier-like tokens: eight or more letters, digits and joiners, two digits among them.
TOKEN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9_.:/-]{6,}[A-Za-z0-9](?![A-Za-z0-9])")
DIGIT_RUN = re.compile(r"[0-9]")
BEFORE = re.compile(r"(\S{1,24})\s*\S{0,3}\Z")
AFTER = re.compile(r"\S{0,3}\s*(\S{1,24})")

#: Least length of a random-looking string and least number of its letters and of its digits.
SECRET, MIXED = 32, 8
MIN_SEEDS = 3
#: Rows whose occurrences a worker holds as Python objects at once.
SLICE = 1000
CONFIDENCE = 0.7
ROUNDS = 2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        # the leftmost match at an @ takes all of the local run before it; what fails there fails from every later start
        start = at
        while start > free and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if DIGIT_RUN.search(text) is None:
        return out
    for m in IP_RUN.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def secret(token: str) -> bool:
    """A long string of letters and digits without a joiner, many of each."""
    if len(token) < SECRET or not token.isalnum():
        return False
    digits = sum("0" <= c <= "9" for c in token)
    return digits >= MIXED and len(token) - digits >= MIXED


def show(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shape(token: str) -> str:
    """Runs of character classes with capped lengths, e.g. 16 digits is 'd16'."""
    out = []
    for m in re.finditer(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]", token):
        s = m.group()
        out.append(f"{'a' if s[0].isalpha() else 'd'}{min(len(s), 20)}" if s[0].isalnum() else s)
    return "".join(out) if len(out) <= 6 else f"mixed{min(len(token), 40)}"


def _patterns(text: str, a: int, b: int, form: str) -> list[str]:
    left = BEFORE.search(text, max(0, a - 32), a)
    right = AFTER.match(text, b, min(len(text), b + 32))
    lw = left.group(1).lower() if left else "^"
    rw = right.group(1).lower() if right else "$"
    return [f"{form}|l:{lw}", f"{form}|r:{rw}", f"{form}|l:{lw}|r:{rw}"]


def occurrences(text: str) -> tuple[list[tuple[str, int, int]], list[dict]]:
    """Base spans, and identifier-like occurrences with their patterns; seeds carry their kind."""
    spans = base_spans(text)
    found = []
    taken = sorted((a, b) for _, a, b in spans)
    for k, a, b in spans:
        form = "email" if k == "email" else shape(text[a:b])
        found.append({"start": a, "end": b, "instance": text[a:b].lower(), "kind": k, "patterns": _patterns(text, a, b, form)})
    if DIGIT_RUN.search(text):
        i = 0
        for m in TOKEN.finditer(text):
            a, b = m.span()
            if sum(map(str.isdigit, m.group())) < 2:
                continue
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i < len(taken) and taken[i][0] < b:
                continue
            found.append({"start": a, "end": b, "instance": m.group().lower(), "kind": "secret" if secret(m.group()) else None, "patterns": _patterns(text, a, b, shape(m.group()))})
    return spans, found


_OCC = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))]))
_OCC_SQL = "array<struct<start:bigint,end:bigint,instance:string,kind:string,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base spans and occurrences of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            rows: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base", "occ")}
            for t in batch.column(1):
                spans, occ = occurrences(t.as_py() or "")
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in spans))
                rows["base"].append(show(spans))
                rows["occ"].append(occ)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(rows[f"n_{k}"], pa.int64()) for k in KINDS), pa.array(rows["base"], pa.string()), pa.array(rows["occ"], _OCC)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "occ"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.task(run), f"doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, occ {_OCC_SQL}")


def learn_patterns(occ: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) of the accepted patterns, from rows (instance, seed, patterns)."""
    edges = common.durable(
        occ.select(F.xxhash64("instance").alias("instance"), "seed", F.explode(F.array_distinct("patterns")).alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    )
    scores = edges.select("pattern", "instance", F.col("seed").cast("double").alias("s"), "seed")
    patterns = None
    for r in range(rounds):
        patterns = scores.groupBy("pattern").agg(F.avg("s").alias("confidence"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        if r + 1 < rounds:
            inst = _join_patterns(edges, patterns.where(F.col("seeds") >= min_seeds)).groupBy("instance").agg(F.max("confidence").alias("c"))
            scores = edges.join(inst, "instance", "left").select("pattern", "instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("s"), "seed")
    return patterns.where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= confidence)).select("pattern", "confidence")


def _join_patterns(rows: DataFrame, patterns: DataFrame, salts: int = 16) -> DataFrame:
    """``rows`` (with pattern) joined with a row of each pattern; a frequent pattern's rows are spread over ``salts`` keys."""
    spread = patterns.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "pattern"]), F.lit(salts)).cast("int")).join(spread, ["pattern", "_salt"]).drop("_salt")


def find(docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base (spans as text), extra (array of (kind, start, end))."""
    rows = common.durable(scan(docs).withColumn("_row", F.monotonically_increasing_id()))
    each = rows.where(F.size("occ") > 0).select("_row", F.explode("occ").alias("o")).select("_row", "o.*").withColumn("seed", F.col("kind").isNotNull())
    accepted = learn_patterns(each, min_seeds, confidence)
    new = (
        _join_patterns(each.where(~F.col("seed")).select("_row", "start", "end", F.explode("patterns").alias("pattern")), accepted.select("pattern"))
        .select("_row", "start", "end", F.lit("other").alias("kind"))
        .unionByName(each.where(F.col("kind") == "secret").select("_row", "start", "end", "kind"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("extra"))
    )
    return rows.drop("occ").join(new, "_row", "left").drop("_row")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets."""
    key, name = common.free_name(docs, "_key"), common.free_name(docs, "_spans")
    rows = common.keyed(docs, key)
    found = find(rows.select(F.col(key).alias("doc_id"), "text")).where((F.col("base") != "") | F.col("extra").isNotNull())
    spans = common.bounded(found.select(F.col("doc_id").alias(key), _all_spans().alias(name)), F.octet_length(name) + 32)

    @F.arrow_udf("string")
    def masked(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array((_mask(t.as_py(), s.as_py()) for t, s in zip(text, spans, strict=True)), pa.string())

    # Python gets only the texts that change: it is called for every row, whatever stands around it
    hit = rows.join(spans, key, "left")
    text = masked(F.when(F.col(name).isNotNull(), F.col("text")), F.col(name))
    return hit.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def _all_spans() -> Column:
    """Base spans, then those of kind ``other``, as text."""
    more = F.array_join(F.transform(F.col("extra"), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), more)


def _mask(text: str | None, spans: str | None) -> str | None:
    if not spans or text is None:
        return text
    out, at = [], 0
    for a, b, k in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        _all_spans().alias("spans"),
        (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.when(F.col("extra").isNull(), 0).otherwise(F.size("extra"))).cast("long").alias("n_spans"),
    )
