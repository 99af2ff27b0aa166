import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dagloom.llm.prefix_tokens import counter

TEXTS = [
    "",
    " ",
    "  leading and  double   spaces \n\n end \n",
    "it's we'll they've you're 'tis 'sword !'s 'll",
    "a<|endoftext|>b <|endoftext|><|endoft x",
    "Zürich naïve façade — “quotes” 漢字かな 🙂 é 12345 6,789",
    "\t\ttabs\n \n mixed nbsp em  　",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa!!!!!!!!!!!!!!!!====------",
    "internationalization antidisestablishmentarianism supercalifragilistic",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(library, text):
    c = counter("byte_bpe_50k.json")
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert c.prefix_counts(text).tolist() == want
    assert c.count(text) == want[-1]
    for budget in {0, 1, want[-1] // 2, want[-1]}:
        cut = c.fit(text, budget)
        assert want[cut] <= budget
        if want[-1] <= budget:
            assert cut == len(text)


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(library, text):
    check(library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab thes'rl lve.!\n\t1é漢<|>"), max_size=40))
def test_random_prefixes(library, text):
    check(library, text)
