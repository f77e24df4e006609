"""Token ids of texts, for a byte-level tokenizer file given by its content."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from frostgrid.llm.tokens import _OTHER_CHARACTERS

_ENCODERS: dict[int, ByteEncoder] = {}

# Fixed value: how a byte-level tokenizer file splits texts into words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it can be seen, else a number from 256."""
    seen = [b for b in range(256) if 33 <= b < 127 or 161 <= b != 173]
    hidden = [b for b in range(256) if b not in seen]
    return {**{chr(b): b for b in seen}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class ByteEncoder:
    """Encodes texts as the file's own tokenizer does, by a faster library that merges bytes by rank.

    In such a file a token's id is its rank, so the vocabulary is all that is
    needed. A text with special tokens or with characters that the two
    libraries may class unlike goes to the tokenizer, as do all texts if the
    file splits or numbers otherwise.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        spec = json.loads(content)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        byte_of = byte_characters()
        ranks = {
            bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items()
            if token not in special and byte_of.keys() >= set(token)
        }
        merges = ["".join(pair) if isinstance(pair, list) else pair.replace(" ", "") for pair in model["merges"]]
        numbers = [model["vocab"].get(token, -1) for token in merges]
        as_expected = (
            spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space", True) and not model.get("ignore_merges")
            and len(ranks) == 256 + len(numbers) and numbers == sorted(set(numbers)) and min(numbers, default=256) >= 256
        )
        self.ranked = None
        if as_expected:
            self.ranked = tiktoken.Encoding("of the file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, without special tokens."""
        for text in texts:
            rare = not text.isascii() and _OTHER_CHARACTERS.search(text)
            if self.ranked is None or rare or self.special.search(text):
                yield np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            else:
                yield np.array(self.ranked.encode_ordinary(text), np.uint32)


def byte_encoder(content: str) -> ByteEncoder:
    """The encoder for a tokenizer file, one per process."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteEncoder(content)
    return _ENCODERS[key]
