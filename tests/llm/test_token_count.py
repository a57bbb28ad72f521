import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm.token_count import WholeTokens, op8_whole_token_counts
from tests.llm.conftest import corpus

PATH = public_tokenizers.path("byte_bpe_50k.json")
with open(PATH, encoding="utf-8") as f:
    COUNTER = WholeTokens(f.read())
LIBRARY = Tokenizer.from_file(PATH)


def test_query_against_library(spark, folder):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in op8_whole_token_counts(spark, folder).collect())
    want = []
    for i, text, *_ in corpus():
        n = len(LIBRARY.encode(text or "", add_special_tokens=False).ids)
        want.append((str(i), len((text or "").encode()), n, n > 1024))
    assert got == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\x0b\xa0 'sdtlrevm.,<|>endoftext019½éßا漢😀́\x1c")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_special_strings_and_memo():
    for text in ("a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "we'll   see  \n\n x "):
        assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    COUNTER.MEMO = 10
    words = " ".join(f"qz{i}x" for i in range(100))
    assert [COUNTER.count(words) for _ in range(3)] == [len(LIBRARY.encode(words).ids)] * 3


def test_proof_is_of_the_merges():
    proven = set(COUNTER.proven)
    assert " the" in proven and "<|endoftext|>" not in proven and len(proven) > 40_000
    for text in list(proven)[::997]:
        assert len(LIBRARY.encode(text).ids) == 1
