import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from onomast.llm.tokens import Encoder

KINDS = [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "bare")]
TOKENIZERS = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f, _ in KINDS}
HARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "it's they'LL we're", "x.,;: , . y", "Ünïcödé straße İstanbul ﬁ ǅ",
    "é ́ áb", "<|endoftext|> a <|startoftext|>b", "a b  c\x1fd", "中文 字 かな 한글 🙂🙂 a🙂b", "word" * 3000, "1234 5.6 a1b2", "\t\ta\r\n b", "ªº x² ½",
]


def agree(texts):
    for f, kind in KINDS:
        ids, at = Encoder.of(public_tokenizers.path(f), kind).encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == TOKENIZERS[f].encode(t or "", add_special_tokens=False).ids, (kind, t)


def test_hard_texts():
    agree(HARD)
    agree(HARD[::-1] * 2)
    agree([])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aBé. ,'\n\t s1!", max_size=40), st.text("aİßÅéͅ Σς.", max_size=12)), max_size=5))
def test_agrees_with_the_library(texts):
    agree([t.encode("utf-8", "ignore").decode() for t in texts])


if __name__ == "__main__":
    pytest.main([__file__])
