"""Personal data: base patterns, and contextual extraction bootstrapped from them.  DataFrame functions only.

Seed entities are the base matches (email, ip, card, phone) and, of the kind ``secret``, strings of two public formats: access
key ids (AKIA and 16 capitals or digits) and quoted digests (32, 40 or 64 hexadecimal digits).  Candidates are other tokens
with digits or an at sign; a value behind an assignment (``word=value``, ``word = "value"``) is a candidate without it.
The lexical patterns of either are its left word with its character shape, its two left words, and where a word is assigned the
value, the word and the assignment, each with the value's class of characters.  Patterns and instances
(a token's text) form a graph: a pattern's confidence in a kind is the mass of its distinct instances known to
be of that kind over that of all its instances, an instance's score the noisy-or of its patterns' confidences; ``rounds`` rounds of
mutual scoring let high-confidence patterns discover identifiers that no base pattern matches.  An instance of no known kind
counts whole against a pattern of words, as prose may hold anything there; against an assignment it counts
``doubt`` of one, as only instances known to be of another kind tell against those.

Null texts count as empty: no span.  Ties between kinds go to the higher score, then the kind listed first.  Rows are told apart by a number
of their own, so repeated rows repeat and rows without or of one ``doc_id`` keep their own spans; extra
columns are ignored; an empty table gives an empty result.  Positions are in characters, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Kinds in their fixed order.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4

# The base patterns with the same leftmost matches, written so that a scan is linear: a match may only begin at the
# beginning of a run or where the last match ended (\G), and runs are taken whole (possessive).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
SIGN = "[0-9@]|AKIA"
TOKEN = rf"(?<!\S)\S*(?:{SIGN})\S*"
#: Seeds of secrets: access key ids, quoted digests.
ACCESS_KEY = "(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
DIGEST = "(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
SPAN = "struct<start:int,end:int,kind:int,token:string,left:string,left2:string>"
#: Matches whose lengths are summed one by one.
STRIDE = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value found once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _ends(sizes: Column) -> Column:
    """Running sums of an array: by strides, so that the work stays near linear in long arrays."""

    def of(x: Column) -> Column:
        stride = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(STRIDE)), lambda at: F.aggregate(F.slice(x, at + 1, F.lit(STRIDE)), F.lit(0), lambda a, v: a + v))
        base = F.aggregate(stride, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        both = F.struct(x.alias("x"), base.alias("base"))
        return _let(both, lambda s: F.transform(s["x"], lambda _, i: F.get(s["base"], F.floor(i / STRIDE).cast("int")) + F.aggregate(F.slice(s["x"], i - i % STRIDE + 1, i % STRIDE + 1), F.lit(0), lambda a, v: a + v)))

    return _let(sizes, of)


def _matches(text: Column, pattern: str, need: str) -> Column:
    """``array<struct<start,end,token,gap>>`` of the non-overlapping matches; ``gap`` is the text between the match before and this one."""
    tokens, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(tokens, F.slice(gaps, F.lit(1), F.size(tokens)), lambda t, g: F.struct(t.alias("token"), g.alias("gap")))

    def placed(p: Column) -> Column:
        ends = _ends(F.transform(p, lambda m: F.length(m["gap"]) + F.length(m["token"])))
        return F.zip_with(p, ends, lambda m, e: F.struct((e - F.length(m["token"])).alias("start"), e.alias("end"), m["token"].alias("token"), m["gap"].alias("gap")))

    return F.when(text.rlike(need), _let(pairs, placed))


def _context(gap: Column) -> tuple[Column, Column]:
    """The word before, and the two words before."""
    return F.regexp_extract(gap, r"(?:^|\s)(\S+)\s*$", 1).alias("left"), F.regexp_extract(gap, r"(?:^|\s)(\S+\s+\S+)\s*$", 1).alias("left2")


def _valid(kind: str, token: Column) -> Column:
    digits = F.regexp_replace(token, "[^0-9]", "")
    if kind == "ip":
        return token.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, found`` of each row of ``docs(doc_id, text)``: base spans by start and kind, and candidate tokens.

    ``row`` tells rows apart; it lasts once the result is written.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    signs = F.col("text").rlike(SIGN)

    def of(kind: str) -> Column:
        kept = F.filter(_matches(F.col("text"), PATTERNS[kind], NEEDS[kind]), lambda m: _valid(kind, m["token"]))
        spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), m["token"].alias("token"), *_context(m["gap"])))
        return F.coalesce(F.when(signs, spans), F.array().cast(f"array<{SPAN}>"))

    # Ordered by start, then kind; spans of one kind never share a start.
    spans = F.array_sort(F.concat(*(of(k) for k in KINDS[:BASE])), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    found = F.transform(_matches(F.col("text"), TOKEN, SIGN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["token"].alias("token"), *_context(m["gap"])))
    return rows.select("row", "doc_id", spans.alias("base"), F.when(signs, found).alias("found"))


def _candidates(base: DataFrame) -> DataFrame:
    """``row, start, end, token, left, left2, key, quoted, seed`` of the tokens that no base span overlaps."""
    item = base.where(F.size("found") > 0).select("row", "base", F.explode("found").alias("c"))
    # "word=value" in one token: the word is context; "word = value" has it in the words before.
    inner = F.regexp_extract("c.token", r"^([A-Za-z_]\w*[=:])[^=:]+$", 1)
    body = F.substring("c.token", F.length(inner) + 1, F.length("c.token"))
    lead = F.length(body) - F.length(F.regexp_replace(body, r"^[^0-9A-Za-z+(]+", ""))
    cut = item.select("row", "base", "c.left", "c.left2", inner.alias("inner"), body.alias("body"), (F.col("c.start") + F.length(inner) + lead).alias("start"), F.regexp_replace(body, r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$", "").alias("token"))
    outer = F.when(F.col("left").rlike("^[=:]$"), F.regexp_extract("left2", r"(\w+)\s+[=:]$", 1)).otherwise(F.regexp_extract("left", r"^(\w+)[=:]$", 1))
    key = F.lower(F.when(F.col("inner") != "", F.rtrim("inner", F.lit("=:"))).otherwise(outer))
    made = cut.select("row", "base", "start", (F.col("start") + F.length("token")).alias("end"), "token", F.when(F.col("inner") != "", F.col("inner")).otherwise(F.col("left")).alias("left"), "left2", key.alias("key"), F.col("body").rlike("^[\"']").alias("quoted"))
    free = F.expr("not exists(base, b -> b.start < end and start < b.end)")
    secret = F.col("token").rlike(f"^{ACCESS_KEY}$") | (F.col("quoted") & F.col("token").rlike(DIGEST))
    return made.where(free & (F.col("token") != "")).withColumn("seed", F.when(secret, KINDS.index("secret"))).drop("base")


def _class(token: Column) -> Column:
    """The class of a value's characters, and whether it is long."""
    kind = F.when(token.rlike("^[0-9]+$"), "digits").when(token.rlike("(?i)^[0-9a-f]+$"), "hex").when(token.rlike("^[0-9A-Za-z]+$"), "alnum").otherwise("mixed")
    return F.concat(kind, F.when(F.length(token) >= 12, "+").otherwise(""))


def bootstrap(base: DataFrame, rounds: int = 3, min_known: int = 3, min_confidence: float = 0.7, min_score: float = 0.75, min_signs: int = 7, doubt: float = 0.1) -> DataFrame:
    """``row, start, end, kind, token, score`` of spans that base patterns do not match, from :func:`base_spans`.

    A pattern counts from ``min_known`` distinct known instances and ``min_confidence``; an instance is accepted from
    ``min_score``, and must have ``min_signs`` letters or digits.  Seeds of secrets are accepted as they are.
    """
    other = _candidates(base).where(F.col("seed").isNotNull() | (F.length(F.regexp_replace("token", "[^0-9A-Za-z]", "")) >= min_signs))
    seeded = base.where(F.size("base") > 0).select("row", F.explode("base").alias("b")).select("row", "b.start", "b.end", "b.token", "b.left", "b.left2", F.lit("").alias("key"), F.lit(False).alias("quoted"), F.col("b.kind").alias("seed"))
    item = seeded.withColumn("is_base", F.lit(True)).unionByName(other.withColumn("is_base", F.lit(False))).withColumn("left", F.lower("left")).withColumn("left2", F.lower(F.regexp_replace("left2", r"\s+", " ")))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    value = _class(F.col("token"))
    patterns = F.filter(
        F.array(
            F.when(F.col("left") != "", F.concat(F.lit("1|"), "left", F.lit("|"), shape)),
            F.when(F.col("left2") != "", F.concat(F.lit("2|"), "left2")),
            F.when(F.col("key") != "", F.concat(F.lit("=|"), "key", F.lit("|"), value)),
            F.when(F.col("key") != "", F.concat(F.lit("=|*|"), value)),
        ),
        lambda p: p.isNotNull(),
    )
    item = blocks.cut(item.select("row", "start", "end", "token", "seed", "is_base", patterns.alias("patterns")))
    # Copies of a text give an edge once: edges are distinct (pattern, instance) pairs.
    edges = blocks.cut(item.select(F.explode("patterns").alias("pattern"), "token", "seed").groupBy("pattern", "token").agg(F.max("seed").alias("seed")))
    seeds = item.where("seed is not null").groupBy("token").agg(F.max("seed").alias("kind")).select("token", "kind", F.lit(1.0).alias("score"))
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scored = blocks.cut(seeds)
    for _ in range(rounds):
        knowing = edges.join(scored, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("k"))
        # All known instances of the pattern, of whatever kind, are one row a kind here.
        known = knowing.groupBy("pattern").agg(F.sum("k").alias("known"))
        unknown = (F.col("n") - F.col("known")) * F.when(F.col("pattern").startswith("="), doubt).otherwise(1.0)
        trusted = knowing.join(totals, "pattern").join(known, "pattern").withColumn("confidence", F.col("mass") / (F.col("known") + unknown)).where((F.col("k") >= min_known) & (F.col("confidence") >= min_confidence))
        # A confidence of 1 is held under 1, as a pattern may still fail.
        fails = F.ln(1 - F.least(F.col("confidence"), F.lit(0.98)))
        told = edges.join(trusted.select("pattern", "kind", fails.alias("fails")), "pattern").groupBy("token", "kind").agg((1 - F.exp(F.sum("fails"))).alias("score")).where(F.col("score") >= min_score)
        best = told.groupBy("token").agg(F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("b")).select("token", (-F.col("b.minus")).alias("kind"), "b.score")
        scored = blocks.cut(seeds.unionByName(best.join(seeds, "token", "left_anti").select("token", "kind", "score")))
    return item.where("not is_base").join(scored, "token").where(F.col("seed").isNotNull() | (F.col("score") < 1) | (F.col("kind") >= BASE)).select("row", "start", "end", F.coalesce("seed", "kind").alias("kind"), "token", "score")


def _join(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """Counts, base digest and all spans of each row of ``docs(doc_id, text)``; ``n_added`` counts those the base patterns do not match,
    ``n_secret`` those of them that are secrets."""
    base = blocks.cut(base_spans(docs))
    added = bootstrap(base, **options).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind", "token", F.lit("").alias("left"), F.lit("").alias("left2"))).alias("added"))
    joined = base.select("row", "doc_id", "base").join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    every = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE])]
    secret = F.expr(f"cast(size(filter(added, s -> s.kind = {KINDS.index('secret')})) as long)")
    return joined.select("doc_id", *counts, F.sha2(_join(F.col("base")), 256).alias("base_sha256"), _join(every).alias("spans"), F.size("added").cast("long").alias("n_added"), secret.alias("n_secret"))
