"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base spans (e-mail, ip, card, phone) come from linear regular expressions with their
checks, row by row.  They are the seeds: the up to two words before a seed are a
lexical pattern.  Tokens with ``LEAST_DIGITS`` digits or more that are no base span are
candidates, with their own patterns.  The distinct (pattern, instance) pairs form a graph.  In every
round a pattern is trusted if at least ``SUPPORT`` of its instances are known and
they are ``CONFIDENCE`` of all its instances (plus one, so that few say little);
trusted patterns make their candidates known, which may make more patterns trusted.
It ends when a round finds nothing new; known instances only grow, so it does.  Every
occurrence of a candidate found so becomes a span of kind ``found``.

Only pairs of short strings are shuffled, never texts; groups are summed map-side, so
a pattern or value in a third of all rows is one row per task.

Defined results: null or empty text has no spans; offsets are code points, end
exclusive; ids pass through, null and repeated ones too; rows repeating id and text
get the same spans; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import bind, materialize, text_of

# The kinds in their listed order and what they match.  Possessive loops
# and the look-behind keep every scan linear and change no match.
KINDS = ("email", "ip", "card", "phone", "found")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind to occur in it: a cheap look before the scan.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# A token with a letter and LEAST_DIGITS digits or more.  One with a run of as many digits as
# a card is left to the card's pattern, so that a seed in it stays one, unless it has a short
# upper-case head.
LEAST_DIGITS = 5      # of a candidate
TOKEN = (rf"(?=(?:[A-Za-z_-]*+[0-9]){{{LEAST_DIGITS}}})(?=[0-9_-]*+[A-Za-z])"
         r"(?![A-Za-z0-9_-]*?(?<![0-9])[0-9](?:-?[0-9]){13,18}+(?!-?[0-9]))"
         r"[A-Za-z0-9]++(?:[_-]++[A-Za-z0-9]++)*+")
IDENTIFIER = rf"(?<![A-Za-z0-9])(?:{TOKEN}|[A-Z]{{1,3}}[0-9][0-9A-Z-]{{4,}})"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# The last two words of a text read backwards: anchored, so linear for words of any length.
CONTEXT = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?"
PATTERN_CHARS = 40                 # longer patterns are told apart by their digest
SUPPORT, CONFIDENCE = 5, 0.8
_BLOCK = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return bind(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))


def matches(text: Column, pattern: str, needs: str) -> Column:
    """array of (start, end, value, before): leftmost non-overlapping matches and the
    text since the one before.  Starts are two-level running sums of lengths."""
    def build(c):
        m, p = c["m"], c["p"]
        sizes = F.transform(m, lambda v, i: (F.length(F.get(p, i)) + F.length(v)).cast("long"))
        total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

        def blocks(s):
            last = F.floor((F.size(s) - 1) / _BLOCK).cast("int")
            return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(s, b * _BLOCK + 1, _BLOCK)))

        def row(s, sums, v, i):
            b = F.floor(i / _BLOCK).cast("int")
            to = total(F.slice(sums, F.lit(1), b)) + total(F.slice(s, b * _BLOCK + 1, i % _BLOCK + 1))
            return F.struct((to - F.length(v)).alias("start"), to.alias("end"), v.alias("value"),
                            F.get(p, i).alias("before"))

        found = bind(sizes, lambda s: bind(blocks(s), lambda sums: F.transform(m, lambda v, i: row(s, sums, v, i))))
        return found

    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,value:string,before:string>>)")
    all_matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = bind(all_matches, lambda m: F.when(F.size(m) > 0, bind(
        F.struct(m.alias("m"), F.split(text, pattern, -1).alias("p")), build)).otherwise(none))
    return F.when(text.rlike(needs), found).otherwise(none)


def _context(before: Column) -> Column:
    last = F.reverse(F.regexp_extract(F.reverse(before), CONTEXT, 0))
    words = F.trim(F.lower(F.regexp_replace(last, r"[\x20\x09-\x0D]+", " ")))
    return bind(words, lambda w: F.when(F.length(w) > PATTERN_CHARS, F.md5(w)).otherwise(w))


def _base(text: Column) -> Column:
    """Sorted array of (start, kind, end)."""
    def of(n, kind):
        kept = F.filter(matches(text, PATTERNS[kind], NEEDS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"),
                                                    m["end"].alias("end")))

    return F.sort_array(F.concat(*[of(n, k) for n, k in enumerate(PATTERNS)]))


def _nodes(text: Column) -> Column:
    """array of (start, end, pattern, inst, seed): seeds and candidates with their patterns."""
    order = ("email", "ip", "phone", "card")
    both = "|".join([*(PATTERNS[k] for k in order[:-1]), IDENTIFIER, PATTERNS["card"]])

    def seed(v):
        out = F.lit(False)
        for k in order:
            out = out | (v.rlike(f"^(?:{PATTERNS[k]})$") & _valid(k, v))
        return out

    marked = F.transform(matches(text, both, "[0-9@]"), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), _context(m["before"]).alias("pattern"),
        F.xxhash64(m["value"]).alias("inst"), seed(m["value"]).alias("seed"),
        (F.length(_digits(m["value"])) >= LEAST_DIGITS).alias("shaped")))
    return F.filter(marked, lambda m: m["seed"] | m["shaped"])


def trusted_instances(pairs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(inst): candidates found over trusted patterns; ``pairs`` has (pattern, inst, seed)."""
    edges = materialize(pairs.where("pattern <> ''").groupBy("pattern", "inst").agg(F.max("seed").alias("seed")))
    found = edges.select("inst").limit(0)
    while True:
        cur = edges.join(found.withColumn("new", F.lit(True)), "inst", "left").select(
            "pattern", "inst", (F.col("seed") | F.col("new").isNotNull()).alias("known"))
        good = materialize(cur.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("known").alias("k"))
                           .where((F.col("k") >= support) & (F.col("k") >= confidence * (F.col("n") + 1))
                                  & (F.col("k") < F.col("n"))).select("pattern"))
        new = materialize(cur.where("NOT known").join(good, "pattern").select("inst").distinct())
        if new.isEmpty():
            return found
        found = materialize(found.union(new))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, n_found, base_sha256, spans."""
    text = text_of(text_col)
    rows = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"),
                                   _base(text).alias("base"), _nodes(text).alias("nodes")))
    nodes = rows.select("id", "th", F.explode("nodes").alias("n")).select("id", "th", "n.*")
    insts = trusted_instances(nodes.select("pattern", "inst", "seed"), support, confidence)
    found = (nodes.where("NOT seed").join(insts, "inst")
             .groupBy("id", "th").agg(F.collect_set(F.struct(
                 F.col("start"), F.lit(len(KINDS) - 1).alias("kind"), F.col("end"))).alias("more"))
             .select(F.col("id").alias("_i"), F.col("th").alias("_t"), "more"))
    same = F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))
    joined = rows.select("id", "th", "base").join(materialize(found), same, "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    form = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(            # noqa: E731
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    more = F.coalesce("more", F.expr("CAST(array() AS array<struct<start:bigint,kind:int,end:bigint>>)"))
    every = F.sort_array(F.concat("base", more))
    counts = [F.expr(f"size(filter(base, s -> s.kind = {n}))").cast("long").alias(f"n_{k}")
              for n, k in enumerate(KINDS[:-1])]
    return joined.select(F.col("id").alias(id_col), *counts, F.size(more).cast("long").alias("n_found"),
                         F.sha2(form(F.col("base")), 256).alias("base_sha256"), form(every).alias("spans"))
