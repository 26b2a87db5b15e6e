import random

from tabsense.llm import line_dedup as L


def brute(rows, least):
    """Kept text of every row; rows in order of id and text hash, each unit once."""
    units = sorted({(i is not None, i or 0, th, t or "") for i, th, t in rows})
    seen, kept = set(), {}
    for some, i, th, text in units:
        lines = text.split("\n")
        real = [n for n, x in enumerate(lines) if x.split()]
        toks = [tuple(lines[n].split()) for n in real]
        gone = set()
        for a in range(len(real)):
            now = []
            for b in range(a, len(real)):
                if sum(map(len, toks[a:b + 1])) >= least:
                    run = tuple(toks[a:b + 1])
                    if run in seen:
                        gone.update(range(real[a], real[b + 1] if b + 1 < len(real) else len(lines)))
                    now.append(run)
            seen.update(now)
        kept[(some, i, th)] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return [None if t is None else kept[(i is not None, i or 0, th)] for i, th, t in rows]


def check(df, least):
    from pyspark.sql import functions as F

    src = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text", "n").collect()
    want = brute([(r[0], r[1], r[2]) for r in src], least)
    got = L.line_dedup(df, min_words=least)
    assert got.columns == df.columns
    key = lambda x: (x[0], str(x[1]))
    assert sorted(((r.n, r.text) for r in got.collect()), key=key) == sorted(
        ((r[3], t) for r, t in zip(src, want)), key=key)
    return got


def test_random_runs(spark):
    rng = random.Random(11)
    for least in (1, 4, 9):
        pool = [" ".join(rng.choices("abcdef", k=rng.choice((1, 1, 2, 3, 5)))) for _ in range(9)] + ["", "  "]
        rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choices(pool, k=rng.randint(0, 14))), n)
                for n in range(120)]
        check(spark.createDataFrame(rows, "doc_id long, text string, n long"), least)


def test_edges(spark):
    long = "\n".join(f"line {i} of many" for i in range(90))
    run = "\n".join(f"w{i} x y z" for i in range(20))
    rows = [(1, None), (2, ""), (3, run), (4, "own\n" + run + "\ntail"), (5, long), (6, long + "\nmore"), (4, "other"),
            (7, run), (7, run), (8, "a b c " * 20 + "\n" + "a  b c " * 20)]
    df = spark.createDataFrame([(i, t, n, 7, "fp") for n, (i, t) in enumerate(rows)],
                               "doc_id long, text string, n long, first int, runs string")
    got = check(df, 50)
    by_n = {r.n: r.text for r in got.collect()}
    assert by_n[3] == "own\ntail" and by_n[5] == "more" and by_n[7] == by_n[8] == "" and by_n[0] is None
    assert L.line_dedup(df.limit(0)).count() == 0
    report = {(r.doc_id, r.n_lines, r.kept_lines) for r in L.line_report(df).collect()}
    assert (4, 22, 2) in report and (6, 91, 1) in report and (7, 20, 0) in report


def brute_words(rows, least):
    """Words that stay of every row: a word goes in a run of ``least`` words that has begun before."""
    seen, kept = set(), {}
    for some, i, th, text in sorted({(i is not None, i or 0, th, t or "") for i, th, t in rows}):
        words, gone = text.split(), set()
        for a in range(len(words) - least + 1):
            run = tuple(words[a:a + least])
            if run in seen:
                gone.update(range(a, a + least))
            seen.add(run)
        kept[(some, i, th)] = [w for n, w in enumerate(words) if n not in gone]
    return [kept[(i is not None, i or 0, th)] for i, th, _ in rows]


def test_words_inside_lines(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    for least in (1, 5, 12):
        pool = [" ".join(rng.choices("abcdef", k=rng.choice((2, 7, 15)))) for _ in range(12)]
        rows = [(rng.choice([None, *range(60)]), "".join(rng.choice(pool) + rng.choice(" \n\t") for _ in range(rng.randint(0, 9))), n)
                for n in range(90)]
        df = spark.createDataFrame(rows, "doc_id long, text string, n long")
        src = df.select("doc_id", F.xxhash64("text"), "text", "n").collect()
        want = {r[3]: w for r, w in zip(src, brute_words([r[:3] for r in src], least))}
        got = {r.n: r.text.split() for r in L.line_dedup(df, min_words=least, inside_lines=True).collect()}
        assert got == want


def test_reflowed_passage_goes(spark):
    words = [f"w{i}" for i in range(60)]
    flowed = "\n".join(" ".join(words[i:i + 7]) for i in range(0, 60, 7))
    rows = [(1, " ".join(words)), (2, f"  own head\n\nmore {flowed} tail\n\nend"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.line_dedup(df, inside_lines=True).collect()}
    assert got == {1: rows[0][1], 2: "  own head\n\nmore\ntail\n\nend", 3: None, 4: ""}
    report = {(r.doc_id, r.n_lines, r.kept_lines) for r in L.line_report(df, inside_lines=True).collect()}
    assert (2, 13, 6) in report
    assert L.line_dedup(df.limit(0), inside_lines=True).count() == 0
