"""Token ids of texts by the vocabulary of a public tokenizer's file."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: The id after each document.
END = 0
#: Fixed value: the word pattern of byte-level tokenizers (the pre-tokenizer of GPT-2).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of so much white space are cut out before that pattern sees them, since it remembers each character of one.
LONG_GAP = 1 << 14
#: The characters that the pattern counts as white space, as a class.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = re.compile(f"[{_SPACE}]{{{LONG_GAP},}}")


class Encoder:
    """The byte-level BPE of a tokenizer file: the vocabulary's order is the order of merges. It gives the ids that
    the tokenizers package gives, about five times faster here. Tokens that the file adds are found in the
    text before it is split into words, as that package does."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        added = whole["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added) or whole["normalizer"]:
            raise ValueError(f"{path}: only plainly matched added tokens and no normalizer are supported")
        as_byte = _bytes_of_letters()
        ranks = {bytes(as_byte[c] for c in token): n for token, n in whole["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in added}
        self.vocabulary = 1 + max(*ranks.values(), *self.added.values())
        self._bpe = tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens=self.added)
        self._any_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def ids(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids of a whole text."""
        if len(text) < LONG_GAP or not _GAP.search(text):
            return np.asarray(self._bpe.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x, np.uint32) for x in self._parts(text))])

    def _parts(self, text: str) -> Iterator[np.ndarray | list[int]]:
        """Ids of a text with long runs of white space: between added tokens a run is a word by itself, but for its
        last character, if a word follows that may take it."""
        at = 0
        for found in [*(self._any_added.finditer(text) if self._any_added else ()), None]:
            end = found.start() if found else len(text)
            for gap in _GAP.finditer(text, at, end):
                yield self._bpe.encode_to_numpy(text[at : gap.start()], allowed_special="all")
                at = gap.end() - (gap.end() < end)
                yield self._bpe._encode_single_piece(text[gap.start() : at])
            yield self._bpe.encode_to_numpy(text[at:end], allowed_special="all")
            if found:
                yield [self.added[found[0]]]
                at = found.end()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once in a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_of(text: str | None, path: str) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of a whole text, and the END after them. A null text is empty."""
    return np.append(encoder(path).ids(text or ""), np.uint32(END)).astype("<u4")


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 letters for themselves,
    letters from U+0100 on for the other bytes in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
