"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""
import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsense.llm import host_quality as H
from tabsense.llm.workload import QUERIES

EXTRA = ["_m", "_rejected", "_stay", "_row", "_id", "_text", "_th", "_host", "_source", "_size", "_k", "id", "th",
         "fp", "label", "node", "size", "copies", "rank", "key", "shard", "slot", "sha", "runs", "base", "nodes",
         "n", "k", "host", "rate", "failed", "kept", "component_id", "fingerprint", "task", "spans", "a", "at"]
CLEAN = " ".join(f"word{i} and" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 100003}" for i in range(60_000))
TEXTS = [None, "", " \t\n", "\n\n", "a", CLEAN, CLEAN, CLEAN + " more", LONG, LONG, "x" * 300_000,
         "é𝄞 ß " * 70, "one two three\n" * 40, "#" * 500, "a\x00b " * 60, CLEAN.upper()]


def table(spark, empty=False):
    rows = [(i, "s" * (i % 4) if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[8], (None, None, None), (None, "s", CLEAN), (3, None, "other text of id three")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    df = df.select("*", *[F.lit("text").alias(c) for c in EXTRA])
    return df.limit(0) if empty else df


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for empty in (False, True):
        path = str(tmp_path_factory.mktemp("edges"))
        table(spark, empty).write.parquet(f"{path}/documents.parquet")
        out[empty] = path
    return out


OTHER_TABLES = {"op11_whitening", "op12_vector_codes", "op13_chat_format"}     # tests of their own


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHER_TABLES))
def test_queries_keep_every_row(spark, folders, name):
    ids = Counter(r.doc_id for r in spark.read.parquet(f"{folders[False]}/documents.parquet").collect())
    out = QUERIES[name](spark, folders[False]).collect()
    if name.startswith("op9"):
        got = Counter(r.doc_id for r in out if r.start == 0)
    else:
        got = Counter(r.doc_id for r in out)
    assert got == ids
    assert QUERIES[name](spark, folders[True]).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_table(spark, folders, stage):
    for empty in (False, True):
        docs = spark.read.parquet(f"{folders[empty]}/documents.parquet")
        out = stage(spark, docs, folders[empty])
        assert (out.count() == 0) == empty
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
            assert out.where(" OR ".join(f"`{c}` <> 'text'" for c in EXTRA)).count() == 0


def test_exact_dedup_against_brute_force(spark, folders):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folders[False]}/documents.parquet").collect()]
    size, keep = Counter(t for _, t in rows), {}
    for i, t in rows:
        keep[t] = max([x for x in (keep.get(t), i) if x is not None], default=None)
    want = Counter((i, keep[t], size[t], i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)
                  for r in QUERIES["op1_exact_dedup"](spark, folders[False]).collect())
    assert got == want


def brute_measures(text):
    t = text or ""
    words = [w.decode() for w in t.encode().split()]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
            len(covered))


def test_measures_against_brute_force(spark, folders):
    docs = spark.read.parquet(f"{folders[False]}/documents.parquet").select("doc_id", "source", "text")
    want, hosts = [], defaultdict(list)
    for r in docs.collect():
        m = brute_measures(r.text)
        base = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((r.doc_id, *m, base))
        hosts[r.source].append(base)
    out = H.host_quality(docs).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out]
    assert Counter(got) == Counter(want)
    assert not any(r.kept and r.base_failed for r in out)


def test_failing_host_takes_its_documents(spark):
    """A host whose documents fail almost always is rejected; a clean one keeps all."""
    rows = [(i, "bad", "few words") for i in range(300)] + [(300, "bad", CLEAN)]
    rows += [(400 + i, "good", f"{CLEAN} {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id for r in H.keep_documents(df).collect()}
    assert kept == set(range(400, 500))
    assert {r.doc_id for r in H.host_quality(df).where("kept").collect()} == kept


def test_extra_rules_count_unless_the_host_is_trusted(spark):
    """Junk on a mixed host goes, clean documents stay; on a trusted host a failing one stays too."""
    junk = "a | b | c | " * 10 + CLEAN
    rows = [(i, "mixed", junk if i % 5 == 0 else f"{CLEAN} {i}") for i in range(100)]
    rows += [(100 + i, None, junk if i % 5 == 0 else f"{CLEAN} {i}") for i in range(100)]
    rows += [(1000 + i, "good", junk if i == 0 else f"{CLEAN} {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = Counter(r.doc_id for r in H.keep_documents(df).collect())
    assert kept == Counter([i for i in range(200) if i % 5] + list(range(1000, 1400)))
    assert Counter(r.doc_id for r in H.host_quality(df).where("kept").collect()) == kept
