"""Token ids of texts, for a tokenizer file given by its content."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

KNOWN_WORDS = 600_000
GROUP_WORDS = 30_000
_ENCODERS: dict[int, WordEncoder] = {}

# Characters that Python and the tokenizer's own expressions class alike: up to U+017F but
# for U+0130, which lower case makes two characters of, and dashes, quotes and dots of U+2010 to U+2027.
_PLAIN = [chr(c) for c in range(0x180) if c != 0x130] + [chr(c) for c in range(0x2010, 0x2028)]
_OTHER_CHARACTERS = re.compile("[^" + "".join(map(re.escape, _PLAIN)) + "]")
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == "N")
_SPACES = "".join(re.escape(chr(c)) for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0])

# The normalizers and the splitting expression of a word-level byte-pair tokenizer file.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Encodes texts word by word, and each word once.

    A tokenizer that splits texts into words encodes a word alike wherever it
    stands. Words are split off here and looked up; only words not seen yet go
    to the tokenizer. At most ``KNOWN_WORDS`` are kept, then the table starts
    afresh. A text with rare characters goes to the tokenizer as a whole, as do
    all texts if the file does not split and normalize as expected.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        spec = json.loads(content)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = kinds == _NORMALIZERS and splits[:1] == [_SPLIT]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        # Texts are normalized and split when they get to this one.
        bytes_only = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "ByteLevel"]
        bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *bytes_only]}
        self.of_words = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": bare}))
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.last[number] = bool(suffix) and token.endswith(suffix)
        self.by_word = self.by_word and bool(suffix)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        self.words = re.compile(
            f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
        )
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.counts = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.filled = 0

    @staticmethod
    def _plain_ids(tokenizer, text: str) -> list[int]:
        """The ids of a text, without the offsets that a plain call works out too."""
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> None:
        flat = np.array(self._plain_ids(self.of_words, " ".join(words)), np.uint32)
        ends = np.nonzero(self.last[flat])[0] + 1
        if len(ends) != len(words):
            ids = [self._plain_ids(self.tokenizer, w) for w in words]
            flat = np.fromiter((i for word in ids for i in word), np.uint32)
            ends = np.cumsum([len(word) for word in ids])
        counts = np.diff(ends, prepend=0)
        n, m = len(self.known), len(self.known) + len(words)
        if m > len(self.starts):
            self.starts, self.counts = (np.resize(a, 2 * m) for a in (self.starts, self.counts))
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.filled + len(flat)))
        self.starts[n:m] = self.filled + ends - counts
        self.counts[n:m] = counts
        self.pool[self.filled:self.filled + len(flat)] = flat
        self.filled += len(flat)
        self.known.update(zip(words, range(n, m)))

    def _whole(self, text: str) -> bool:
        return not self.by_word or bool(_OTHER_CHARACTERS.search(text)) or bool(self.special.search(text))

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, without special tokens."""
        return next(iter(self.encode_all([text])))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, with words looked up for about ``GROUP_WORDS`` at a time."""
        group: list[np.ndarray | int] = []
        words: list[str] = []
        for text in texts:
            if self._whole(text):
                group.append(np.array(self._plain_ids(self.tokenizer, text), np.uint32))
            else:
                found = self.words.findall(text.lower())
                group.append(len(found))
                words += found
            if len(words) >= GROUP_WORDS:
                yield from self._looked_up(group, words)
                group, words = [], []
        yield from self._looked_up(group, words)

    def _looked_up(self, group: list[np.ndarray | int], words: list[str]) -> Iterator[np.ndarray]:
        at = list(map(self.known.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at) if i is None))
            if len(self.known) + len(new) > KNOWN_WORDS:
                self._forget()
                new = list(dict.fromkeys(words))
            self._learn(new)
            at = map(self.known.__getitem__, words)
        index = np.fromiter(at, np.int64, len(words))
        counts = self.counts[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[index] - ends + counts, counts) + np.arange(total)]
        word = done = 0
        for of in group:
            if isinstance(of, np.ndarray):
                yield of
            else:
                word += of
                end = int(ends[word - 1]) if word else 0
                yield ids[done:end]
                done = end


def encoder(content: str) -> WordEncoder:
    """The encoder for a tokenizer file, one per process."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(content)
    return _ENCODERS[key]
