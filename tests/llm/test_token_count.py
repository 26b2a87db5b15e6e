import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from tabsense.llm import token_count as T
from tabsense.llm.tokens import piece_vocabulary


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer(Unigram([(p, float(s)) for p, s in T.vocabulary(piece_vocabulary())], 0, True))
    t.pre_tokenizer = Metaspace()
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_documents(spark, exact):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(df, piece_vocabulary()).collect()}
    assert got == dict(zip([r.doc_id for r in rows], exact([r.text for r in rows])))


def test_edges(spark, exact, monkeypatch):
    monkeypatch.setattr(T, "CACHE_SEGMENTS", 4)
    texts = [None, "", " ", "   a  b ", "▁x▁▁y", "<s> <0x41> <unk>", "\n\n\tq\x00", "𝕏🙂 naïve 日本語 ﷽", "z" * 30000,
             "the the the", "🙂🙂🙂" * 50]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts * 2)], "doc_id long, text string, score int")
    got = sorted((r.doc_id, r.n_tokens) for r in T.count_tokens(df, piece_vocabulary()).collect())
    assert got == list(enumerate(exact(texts * 2)))
    assert T.count_tokens(df.limit(0), piece_vocabulary()).count() == 0


def test_ties_take_the_earliest_start():
    c = T.Counter([("<unk>", -99), ("▁", -1), ("a", -2), ("aa", -4), ("aaa", -6), ("b", -1)])
    assert c("aaaa") == (3, -9)
    assert c("é") == (3, -1 - 109)
