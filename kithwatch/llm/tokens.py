"""Token ids of many texts, looked up word by word."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: White space for Python that is none for the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Punctuation that is one piece of text for the tokenizer when it follows letters.
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


def _plain(text: str) -> bool:
    """Only characters whose lower case depends on nothing else (up to U+00FF)."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class Encoder:
    """Ids of texts. White space always separates tokens, so ids are looked up word by word.

    A word of letters with punctuation after it is two tokens' worth of text for the tokenizer,
    so only the letters are encoded anew; many such words go through it as one text and are
    told apart by the tokens that end a word. That holds for letters up to U+00FF, which the
    tokenizer leaves one by one; words with any other character go through it as they are, as
    lower case and normal forms may turn a letter into several characters.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> None:
        for word, got in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = array("I", got.ids).tobytes()

    def _together(self, words: list[str], size: int = 256) -> None:
        groups = [words[k : k + size] for k in range(0, len(words), size)]
        texts = [" ".join(group) for group in groups]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(group) or stops[-1] != ids.nbytes:
                self._each(group)
                continue
            data, start = ids.tobytes(), 0
            for word, stop in zip(group, stops.tolist(), strict=True):
                self.known[word] = data[start:stop]
                start = stop

    def _learn(self, new: set[str]) -> None:
        letters = {word for word in new if word.isalpha() and (word.isascii() or _plain(word))}
        tailed, others = [], set()
        for word in new - letters:
            stem = word.rstrip(_TAIL)
            if stem.isalpha() and (stem.isascii() or _plain(stem)):
                tailed.append((word, stem, word[len(stem) :]))
                letters.add(stem)
                others.add(word[len(stem) :])
            else:
                others.add(word)
        self._together([word for word in letters if word not in self.known])
        self._each([word for word in others if word not in self.known])
        for word, stem, tail in tailed:
            self.known[word] = self.known[stem] + self.known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = []
        for text in texts:
            if _ODD_SPACE.search(text):
                parts.append([text])
            else:
                parts.append((text.lower() if _plain(text) and "|" not in text else text).split())
        new = set().union(*parts) - self.known.keys()
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = set().union(*parts)
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in parts]
