"""Quality rules with host verdicts (DataFrame functions only).

Every document is measured in its own row, without a shuffle: repeated 3-word
windows are found by sorting one long per window (hash bits above, position
bits below) and comparing neighbours, O(n log n) for a text of any length.
Rule failures are then aggregated by host (partial sums first, so a host holding
a third of all rows is one row per task); host failure rates are shrunk with a
beta prior fitted to all hosts by the method of moments, and a host is rejected
when its shrunk rate exceeds ``HostRules.reject_rate``.  Host verdicts are joined
back to the documents.

The host rate also decides how strictly a document's own failures count: one that
fails any rule but the base ones stays only on a trusted host, whose shrunk rate is
``HostRules.trust_rate`` at most.  The base rules always reject.

Defined results: null or wordless text has no words and fails; a null host is a
host of its own; an empty table gives an empty result; repeated rows are measured
alike; other columns are ignored or passed through.  Two different windows of one
text are taken as equal only if all but the low log2(windows) bits of their
64-bit hashes agree.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import SPACE, bind, materialize, text_of

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class DocRules:
    """A document fails if any rule holds; the first two are the base rules."""
    min_words: int = 50
    max_repeat_pct: int = 50        # words in repeated 3-word windows, of all words
    max_symbol_pct: int = 10        # symbols, of all words
    max_dup_line_words: int = 2     # duplicate lines, one per so many words at most
    mean_word: tuple[int, int] = (2, 20)


@dataclass(frozen=True)
class HostRules:
    """``reject_rate`` is high on purpose: a mixed host keeps its clean documents."""
    reject_rate: float = 0.9
    trust_rate: float = 0.05        # a document that fails an extra rule stays only below
    prior_strength: float = 10.0    # used where the hosts' rates do not spread


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows found twice or more, the first ones included."""
    def keys(w, last, m):
        return F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(-m).bitwiseOR(i.cast("long"))))

    def covered(k, last, m):
        top = lambda j: F.get(k, j).bitwiseAND(-m)                                   # noqa: E731
        twin = lambda j: (F.coalesce(top(j) == top(j - 1), F.lit(False))             # noqa: E731
                          | F.coalesce(top(j) == top(j + 1), F.lit(False)))
        places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin),
                                          lambda j: F.get(k, j).bitwiseAND(m - 1)))
        start = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start,
                           lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(
                               F.lit(3).cast("long"), p - acc["at"])).alias("n")),
                           lambda acc: acc["n"])

    def count(w):
        last = F.size(w) - 3
        power = F.pow(F.lit(2.0), F.ceil(F.log2((last + 2).cast("double")))).cast("long")
        return bind(power, lambda m: bind(keys(w, last, m), lambda k: covered(k, last, m)))

    return bind(words, lambda w: F.when(F.size(w) >= 3, count(w)).otherwise(F.lit(0).cast("long")))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measure(docs: DataFrame, text_col: str = "text", rules: DocRules = DocRules()) -> DataFrame:
    """``docs`` with a struct ``_m``: the measures, ``base_failed`` and ``failed`` (any rule)."""
    text = text_of(text_col)
    counts = F.struct(
        words_of(text).alias("words"), F.length(text).alias("chars"),
        F.length(F.regexp_replace(text, "[#*$%&|<>]+", "")).alias("plain"),
        duplicate_lines(text).alias("n_dup_lines"))

    def row(c):
        n = F.size(c["words"]).cast("long")
        chars = F.length(F.array_join(c["words"], "")).cast("long")
        return F.struct(n.alias("n_words"), chars.alias("word_chars"),
                        (c["chars"] - c["plain"]).cast("long").alias("n_symbols"),
                        c["n_dup_lines"].alias("n_dup_lines"),
                        repeat_words(c["words"]).alias("n_repeat_words"))

    def verdict(c):
        n = c["n_words"]
        base = (n < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_pct * n)
        more = ((100 * c["n_symbols"] > rules.max_symbol_pct * n)
                | (rules.max_dup_line_words * c["n_dup_lines"] > n)
                | (c["word_chars"] < rules.mean_word[0] * n) | (c["word_chars"] > rules.mean_word[1] * n))
        return F.struct(*[c[x].alias(x) for x in MEASURES], base.alias("base_failed"),
                        (base | more).alias("failed"))

    return docs.withColumn("_m", bind(bind(counts, row), verdict))


def host_table(measured: DataFrame, host: str, rules: HostRules = HostRules()) -> DataFrame:
    """(host, n, k, rate, rejected): failure rates shrunk towards the hosts' beta prior."""
    hosts = materialize(measured.groupBy(F.col(host).alias("host"))
                        .agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k")))
    rate = F.col("k") / F.col("n")
    total, bad, spread = hosts.agg(F.sum("n"), F.sum("k"), F.var_pop(rate)).first()
    mean = bad / total if total else 0.0
    strength = mean * (1 - mean) / spread - 1 if spread else 0.0
    strength = strength if strength > 0 else rules.prior_strength
    shrunk = (F.col("k") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", shrunk).withColumn("rejected", shrunk > rules.reject_rate)


def stays(base_failed: Column, failed: Column, rejected: Column, trusted: Column) -> Column:
    """Whether a document passes, given its own failures and its host's verdict."""
    return ~base_failed & F.coalesce(F.when(failed, trusted).otherwise(~F.coalesce(rejected, F.lit(False))), F.lit(False))


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 host_col: str = "source", doc_rules: DocRules = DocRules(),
                 host_rules: HostRules = HostRules()) -> DataFrame:
    """id, measures, base_failed, host_rate, kept: one row per input row."""
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{host_col}`").alias("_host"),
                       F.col(f"`{text_col}`").alias("_text"))
    rows = materialize(measure(base, "_text", doc_rules).select("_id", "_host", "_m.*"))
    hosts = host_table(rows, "_host", host_rules)
    return (rows.join(hosts, F.col("_host").eqNullSafe(F.col("host")), "left")
            .select(F.col("_id").alias(id_col), *MEASURES, "base_failed",
                    F.col("rate").alias("host_rate"),
                    stays(F.col("base_failed"), F.col("failed"), F.col("rejected"),
                          F.col("rate") <= host_rules.trust_rate).alias("kept")))


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                   doc_rules: DocRules = DocRules(), host_rules: HostRules = HostRules()) -> DataFrame:
    """The documents that pass, with all their columns.

    Texts are measured twice (host rates first, then the verdict) instead of being
    shuffled or written once more.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{host_col}`").alias("_host"),
                       F.col(f"`{text_col}`").alias("_text"))
    measured = measure(rows, "_text", doc_rules)
    hosts = host_table(measured.select("_host", F.col("_m.failed").alias("failed")), "_host", host_rules)
    hosts = (hosts.withColumn("_trusted", F.col("rate") <= host_rules.trust_rate).where("rejected OR _trusted")
             .select(F.col("host").alias("_named"), F.col("rejected").alias("_rejected"), "_trusted"))
    passes = stays(F.col("_m.base_failed"), F.col("_m.failed"), F.col("_rejected"), F.col("_trusted"))
    return (measured.where(~F.col("_m.base_failed"))
            .join(hosts, F.col("_host").eqNullSafe(F.col("_named")), "left").where(passes).select("_row.*"))
