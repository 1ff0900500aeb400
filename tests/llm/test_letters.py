"""Every Latin letter of the fast pre-split, capitals above all, against the tokenizers library."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe
from lodestone.llm.library_tokens import library_tokens

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = ["Əliyev", "Ɖevi", "Ɓala", *(t for c in map(chr, range(0xA1, 0x250)) for t in (f"{c}liyev", f"a{c}b {c}", f"{c}{c}1"))]


def test_automaton_of_every_latin_letter():
    mine, lib = bpe.word_bpe(WORD), Tokenizer.from_file(WORD)
    for text, e in zip(TEXTS, lib.encode_batch(TEXTS, add_special_tokens=False), strict=True):
        assert mine.encode_text(text) == (" ".join(map(str, e.ids)), lib.decode(e.ids, skip_special_tokens=False), len(e.ids)), text


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_library_tokens_of_every_latin_letter(path):
    lib = Tokenizer.from_file(path)
    got = library_tokens(path).encode_many(TEXTS)
    assert [t for t, x, e in zip(TEXTS, got, lib.encode_batch(TEXTS, add_special_tokens=False), strict=True) if x.tolist() != e.ids] == []
