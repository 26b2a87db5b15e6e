"""The whole pipeline against plain Python, stage by stage on each stage's own input."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tabsense.llm.host_quality import HostRules
from tabsense.llm.tokens import packing_vocabulary
from test_edges import brute_measures
from test_line_dedup import brute_words
from test_mixing import brute_targets

FOLDER = "/root/testdata/sf0.001"


def quality(rows):
    failed, base = {}, {}
    hosts = defaultdict(list)
    for r in rows:
        n, chars, symbols, dup, repeat = brute_measures(r.text)
        base[r.doc_id] = n < 50 or 100 * repeat > 50 * n
        failed[r.doc_id] = base[r.doc_id] or 100 * symbols > 10 * n or 2 * dup > n or chars < 2 * n or chars > 20 * n
        hosts[r.source].append(failed[r.doc_id])
    mean = sum(map(sum, hosts.values())) / len(rows)
    spread = np.var([np.mean(x) for x in hosts.values()])
    strength = mean * (1 - mean) / spread - 1
    rate = {h: (sum(x) + mean * strength) / (len(x) + strength) for h, x in hosts.items()}
    rules = HostRules()
    return {r.doc_id for r in rows if not base[r.doc_id]
            and (rate[r.source] <= rules.trust_rate if failed[r.doc_id] else rate[r.source] <= rules.reject_rate)}


def fingerprint(text):
    words = [w.decode().lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w).decode()
             for w in (text or "").encode().split()]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def survivors(rows):
    prints, group = {r.doc_id: fingerprint(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                lo, hi = sorted((top(a), top(b)))
                group[hi] = lo
    return {i for i in ids if top(i) == i}


def test_stages_and_run(spark, monkeypatch):
    seen = {}
    kept = corpus_pipeline.materialize

    def remember(df):
        out = kept(df)
        seen[len(seen)] = out.collect()
        return out

    monkeypatch.setattr(corpus_pipeline, "materialize", remember)
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    good, cut, alone, mixed = (seen[i] for i in range(4))

    assert {r.doc_id for r in good} == quality(docs) and 0 < len(good) < len(docs)
    by_id = {r.doc_id: r for r in docs}
    assert all(r == by_id[r.doc_id] for r in good)

    keyed = [(r.doc_id, 0, r.text) for r in good]
    words = {i: w for (i, _, _), w in zip(keyed, brute_words(keyed, 50))}
    assert {r.doc_id: r.text.split() for r in cut} == words and sum(map(len, words.values())) < sum(len(t.split()) for _, _, t in keyed)
    assert all(r.n_chars == len(r.text) for r in cut)

    assert {r.doc_id for r in alone} == survivors(cut) and len(alone) < len(cut)
    assert all(r in set(cut) for r in alone)

    sizes, size = defaultdict(list), {r.doc_id: len((r.text or "").encode().split()) for r in alone}
    for r in alone:
        sizes[r.source].append(size[r.doc_id])
    times, taken = Counter(r.doc_id for r in mixed), defaultdict(int)
    source = {r.doc_id: r.source for r in alone}
    assert set(times) <= set(size) and max(times.values()) <= 3 and set(mixed) <= set(alone)
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    for s, target in brute_targets({s: sum(n) for s, n in sizes.items()}).items():
        assert abs(taken[s] - target) <= max(0.01 * target, max(sizes[s]) / 2)

    tokenizer = Tokenizer.from_file(packing_vocabulary())
    text = {r.doc_id: r.text for r in alone}
    found = defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
    assert set(found) == set(times)
    for i, parts in found.items():
        ids = np.array([*tokenizer.encode(text[i], add_special_tokens=False).ids, 2], "<u4")
        assert sum(p.length for p in parts) == times[i] * len(ids)
        assert Counter(int(k) for p in parts for k in range(p.start, p.start + p.length)) == Counter(dict.fromkeys(range(len(ids)), times[i]))
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in parts)
