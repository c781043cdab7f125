import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import ORACLE
from tests.llm.fixtures import AWKWARD, awkward, nothing
from trainkit.llm import queries, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


PIECES = st.sampled_from(["the", " the", "'s", "'ll", "  ", "\n", "\t", "aaaa", "1234", "é", "\U0001f600", "　", "\x85", "\x1c", "\xa0", "<|endoftext|>", "!!!", "ﬀ", "½", "漢字", "THE", " ", "x", "²"])


LIBRARY, OWN = Tokenizer.from_file(PATH), tokens.TokenCounter(PATH)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=25).map("".join), st.text(max_size=80)))
def test_against_the_library(text):
    assert OWN.counts([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def test_long_runs():
    for text in ("a" * 20_001, "=" * 9_999, " " * 5_000 + "x", "ab" * 7_000, "漢" * 3_000):
        assert OWN.counts([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    own = tokens.TokenCounter(PATH)
    texts = ["one two three four five", "six seven eight nine ten eleven twelve thirteen", "one six"]
    assert [own.counts([t])[0] for t in texts] == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_awkward_rows(spark):
    got = sorted(tokens.token_counts(awkward(spark), PATH).collect(), key=repr)
    want = sorted(((r[0], len((r[1] or "").encode()), len(LIBRARY.encode(r[1] or "", add_special_tokens=False).ids)) for r in AWKWARD), key=repr)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert tokens.token_counts(nothing(spark), PATH).count() == 0


def test_query_against_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{ORACLE}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op6_token_counts(spark, ORACLE).collect():
        n = len(LIBRARY.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)
