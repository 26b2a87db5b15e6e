import hashlib
import random
import re

from tabsense.llm import private_data as P

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
            "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    spans = sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(BASE.items())
                   for m in re.finditer(p, text or "") if ok(k, m[0]))
    form = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in spans)
    return [sum(k == n for _, k, _ in spans) for n in range(4)], hashlib.sha256(form.encode()).hexdigest(), form


def check(df, rows):
    out = P.find_private(df).collect()
    assert sorted((str(r[0]), *r[1:5], r.base_sha256) for r in out) == sorted(
        (str(i), *(b := brute(t))[0], b[1]) for i, t in rows)
    for r in out:
        own = [s for s in r.spans.split(",") if s and not s.startswith("found")]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r.base_sha256
        assert r.n_found == r.spans.count("found:")
    return out


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_edges(spark):
    rng = random.Random(2)
    alphabet = ["1", "22", "4111 1111 1111 1111", " ", "-", ".", "@", "a", "b.c", "+4", "(", ")", "255", "é𝕏", "\n", "x@y.zz"]
    texts = [None, "", "a@b.c._x@d.e x@y@z.com", "1.2.3.4.5.6.7.8 0001.002.3.255 256.1.1.1", "9" * 50000, "1 " * 20000,
             "a" * 50000 + "@", "a@b" + ".c" * 20000, "é𝕏 q@r.st " * 700, "4111-1111-1111-1111 +1 (555) 010-9999 x"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(600)]
    rows = list(enumerate(texts)) + [(None, "n@u.ll"), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, th int, spans string")
    check(df, rows)
    assert P.find_private(df.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please call phone: +1 555 010 {1000 + i} today") for i in range(30)]
    rows += [(100, "so call phone: AB123456 now"), (101, "elsewhere AB123456 again"), (102, "build number AB999999 here")]
    rows += [(200 + i, f"build number ZZ{700000 + i} ok") for i in range(20)]
    out = {r.doc_id: r for r in P.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100].spans == "found:15:23" and out[101].spans == "found:10:18"
    assert out[102].n_found == 0 and all(out[200 + i].n_found == 0 for i in range(20))
    assert all(out[i].n_phone == 1 and out[i].n_found == 0 for i in range(30))


def test_chain_of_six_patterns(spark):
    """Eight patterns a level share the values of the level before, each brings one new value."""
    name = lambda level, j: f"Ref-{'abcdefgh'[j]}{10000 + 10 * level + j}x"
    rows, known = [], [f"+1 555 010 {1000 + j}" for j in range(8)]
    for level in range(6):
        new = [name(level, j) for j in range(8)]
        rows += [(100 * level + j, " ".join(f"step{'pqrstu'[level]} kind{'abcdefgh'[j]}: {v} ;" for v in [*known, new[j]]))
                 for j in range(8)]
        known = new
    out = {r.doc_id: r for r in P.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, r in out.items():
        got = [texts[i][int(a):int(b)] for _, a, b in (s.split(":") for s in r.spans.split(",") if s.startswith("found"))]
        level, j = divmod(i, 100)
        assert got == [*([name(level - 1, k) for k in range(8)] if level else []), name(level, j)]


def test_candidates_of_any_shape_and_whole_context_words(spark):
    """Mixed, lower-case and long tokens after a trusted context; contexts are told apart by whole words."""
    long = "w" * 60
    values = ["qx-12345", "12ab345_67", "K9" + "7Z" * 40, "de89370400440532013000", "Ab12345Cd"]
    rows = [(i, f"a{long} phone: +1 555 010 {1000 + i} today") for i in range(30)]
    rows += [(100 + i, f"so a{long} phone: {v}, now") for i, v in enumerate(values)]
    rows += [(200, f"so b{long} phone: zz-12345 now")]
    out = {r.doc_id: r for r in P.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len(f"so a{long} phone: ")
    spans = {i: out[100 + i].spans for i in range(len(values))}
    assert spans == {i: f"found:{at}:{at + len(v)}" for i, v in enumerate(values)}
    assert out[200].n_found == 0
