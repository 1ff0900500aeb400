"""Ids by the tokenizers library, each distinct pre-split word being encoded once while the table of words has room."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

from .bpe import LETTERS
from .common import BYTE_SPLIT, UNSAFE, WORD_SPLIT, rule_of

WORDS_KEPT = 100_000


class Words(dict):
    """word -> bytes of its ids; a word that is not there is encoded by the library's model. Two generations bound the memory: when the newer
    one is full it becomes the older one, from which words come back as they are met."""

    def __init__(self, library, code: str):
        self.tokenize, self.code, self.before = library.model.tokenize, code, {}

    def __missing__(self, word: str) -> bytes:
        got = self.before.get(word)
        if got is None:
            letters = word.encode("utf-8").decode("latin-1").translate(LETTERS)  # the word in the byte alphabet
            got = array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()
        self[word] = got
        return got

    def turn(self) -> None:
        if len(self) >= WORDS_KEPT:
            self.before = dict(self)
            self.clear()


class LibraryTokens:
    """Texts of plain Latin characters without special tokens are split here by the file's own rule, where it is one of
    those known; others go to the library whole. Both give what encode(text, add_special_tokens=False) gives."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            rule = rule_of(json.load(f))
        # a rule that is not known sends every text to the library
        self.whole = re.compile("|".join([UNSAFE.pattern, *map(re.escape, special)]) if rule else "")
        self.lower = rule == "words"
        self.findall = (WORD_SPLIT if self.lower else BYTE_SPLIT).findall
        small = self.library.get_vocab_size() <= 1 << 16
        self.type = np.dtype("<u2" if small else "<u4")
        self.words = Words(self.library, "H" if small else "I")

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        self.words.turn()
        out, take = [], self.words.__getitem__
        for x in texts:
            if self.whole.search(x):
                out.append(np.array(self.library.encode(x, add_special_tokens=False).ids, self.type))
            else:
                out.append(np.frombuffer(b"".join(map(take, self.findall(x.lower() if self.lower else x))), self.type))
        return out


@lru_cache(maxsize=4)
def library_tokens(path: str) -> LibraryTokens:
    """One a worker process."""
    return LibraryTokens(path)
