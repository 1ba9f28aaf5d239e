"""Tokenising whole texts with a public vocabulary file, with a bounded memo of words.

The vocabulary's tokenizer normalises, splits into words and encodes each word
by itself, so a text's ids are its words' ids in order. For texts of Latin
letters the words are found here by the tokenizer's own split rule and looked
up; unknown ones are given to the tokenizer's model. Every other text goes to the
tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

_MEMO = 500_000
#: The split rule that ``_patterns`` follows, as it stands in the vocabulary file (fixed value).
_SPLIT = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters up to here have no combining forms, so normalising leaves them as they are.
_LAST_LATIN = 0x24F


def _class(kind: str) -> str:
    """A regex class body of the characters of one Unicode category up to the last Latin letter, lower-cased."""
    own = {chr(c).lower() for c in range(_LAST_LATIN + 1) if unicodedata.category(chr(c)).startswith(kind)}
    return "".join(re.escape(c) for c in sorted(own) if len(c) == 1)


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    letters, digits = _class("L"), _class("N")
    word = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^ \t-\r\x85\xa0{letters}{digits}]+")
    # İ has two letters in lower case
    other = re.compile(rf"[^\x00-{chr(_LAST_LATIN)}]|İ")
    return word, other


class _Words(dict):
    """The words of one call; others are looked up in the memo."""

    def __init__(self, memo: dict[str, bytes]):
        self._memo = memo

    def __missing__(self, word: str) -> bytes:
        return self._memo[word]


class WordTokenizer:
    """ids(text): little-endian unsigned 32-bit ids of a text, as bytes.

    ``path`` is a ``tokenizers`` JSON file. The memo of words holds at most
    ``_MEMO`` words, the first ones met (frequent words are met early); the rest
    are encoded each time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path) as f:
            model = json.load(f)
        self._model = self._tokenizer.model
        self._bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._by_word = bool(model["model"].get("end_of_word_suffix")) and _SPLIT in json.dumps(model)
        self._memo: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word as the split rule cuts it."""
        plain = word if word.isascii() and word.isprintable() else self._bytes.pre_tokenize_str(word)[0][0]
        return np.array([t.id for t in self._model.tokenize(plain)], dtype="<u4").tobytes()

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none)."""
        word, other = _patterns()
        cut: list[list[str] | str] = []
        unknown: set[str] = set()
        memo = self._memo
        for text in texts:
            if not text:
                cut.append([])
            elif not self._by_word or other.search(text):
                cut.append(text)
            else:
                words = word.findall(text.lower())
                unknown.update(w for w in set(words) if w not in memo)
                cut.append(words)
        new = _Words(memo)
        new.update((w, self._word(w)) for w in unknown)
        out = [self._whole(x) if isinstance(x, str) else b"".join(map(new.__getitem__, x)) for x in cut]
        for w in list(new)[: max(0, _MEMO - len(memo))]:
            memo[w] = new[w]
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each vocabulary file and Python process."""
    return WordTokenizer(path)
