import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from tabsense.llm import packing as P
from tabsense.llm.tokens import packing_vocabulary

PATH = packing_vocabulary()


def whole_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, P.END_ID], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(df, rows, slack):
    """Round trip: pieces cover every document once, sequences are gapless and full."""
    out = P.pack(df, PATH).collect()
    want = defaultdict(list)
    for (i, t), ids in zip(rows, whole_ids([t for _, t in rows])):
        want[i].append(ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for i, docs in want.items():
        if len(docs) > 1 and any(len(d) != len(docs[0]) or (d != docs[0]).any() for d in docs):
            continue
        by_start = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in by_start) == sum(map(len, docs))
        for r in by_start:
            assert r.doc_tokens == len(docs[0])
            assert r.ids_crc32 == zlib.crc32(docs[0][r.start:r.start + r.length].tobytes())
        if len(docs) == 1:
            at = 0
            for r in by_start:
                assert r.start == at
                at += r.length
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= P.LENGTH
        total += at
        padding += 0 if at & (at - 1) == 0 else P.LENGTH - at
    assert padding <= slack * total
    return out


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = check(df, rows, 0.02)
    assert sorted(map(tuple, out)) == sorted(map(tuple, P.pack(df, PATH).collect()))


def test_edges(spark, monkeypatch):
    texts = [None, "", " \t\n", "<|endoftext|> a<|startoftext|>", "x<|endoftext|>y <|ENDOFTEXT|> <|end oftext|>b", "É́ é\x1cx y z don't 'S x'll", "W" * 9000,
             "nostop " * 20000, "One. Two! Three? " * 3000, "日本。語！" * 500, "a" * 3 + "\x0b" + "b\x0cc\x85d"]
    rows = list(enumerate(texts)) + [(None, "null id"), (3, texts[3])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").coalesce(1)
    check(df, rows, 1.0)
    assert P.pack(df.limit(0), PATH).count() == 0
    monkeypatch.setattr(P, "BLOCK", 5000)
    monkeypatch.setattr(P, "CACHE_WORDS", 3)
    check(df, rows, 1.0)


def test_cuts_are_the_best():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randint(4, 12)
        places = [0]
        while len(places) < 14:
            places.append(places[-1] + rng.randint(1, length))
        costs = [rng.choice((0, 1, 3)) for _ in places]

        @lru_cache(None)
        def best(j):
            return 0 if j == 0 else min(best(i) + length - places[j] + places[i] + costs[j]
                                        for i in range(j) if places[j] - places[i] <= length)

        at, cost = 0, 0
        for cut in P.window_cuts(places, costs, length):
            assert cut - at <= length
            cost += length - cut + at + costs[places.index(cut)]
            at = cut
        assert at == places[-1] and cost == best(13)
