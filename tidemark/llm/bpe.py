"""Token ids of whole texts through the tokenizers library, each distinct word encoded once.

Byte-pair encoding never crosses the borders that a vocabulary's pre-tokenizer sets. For texts of plain
Latin-1 characters those borders are the matches of a fixed pattern, so a text's ids are its words'
ids in a row. A new word goes straight to the library's byte-pair model, as its bytes in the byte-level alphabet; words that were
encoded before come from a bounded cache of two generations, in which rare words give way. Any other text goes to the library whole, and so does a
text with the string of an added token ("<|endoftext|>") where such strings become their ids: those cut across the borders.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

# The pre-tokenizer patterns of the two vocabularies, with their Unicode classes spelled out for Latin-1. No
# alternative can start where another does but for "'", so the commonest one stands first.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼½¾"
_S = "\t\n\x0b\x0c\r \x85\xa0"
_SHORT = "'(?:[stmd]|re|ve|ll)"
_BYTE_LEVEL = re.compile(f" ?[{_L}]+|{_SHORT}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_LEVEL = re.compile(f"[{_L}]+|{_SHORT}|[{_N}]|[^{_S}{_L}{_N}]+")
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~\xa0-\xff]*")

#: Words that a worker keeps at most, in two generations; about 200 bytes each.
CACHE_WORDS = 1_000_000


def _byte_alphabet() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers, without special tokens around them.

    With ``added_tokens`` the string of an added token inside a text becomes that token's id, the library's default; else it is ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added_tokens
        # in lower case, as a token may be looked up after the normalizer; a text that only resembles one is encoded whole for nothing
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()] if added_tokens else []
        kind = str(self.library.pre_tokenizer)
        self.words, self.lower = None, False
        if kind.startswith("ByteLevel(add_prefix_space=False") and self.library.normalizer is None:
            self.words = _BYTE_LEVEL.findall
        elif kind.startswith("Sequence(pretokenizers=[Split(") and "Lowercase" in str(self.library.normalizer):
            self.words, self.lower = _WORD_LEVEL.findall, True
        self.young_words = max(1, cache_words // 2)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str] | None:
        """The text's words; none if it has to go to the library whole."""
        if self.words is None or not _PLAIN.fullmatch(text):
            return None
        lower = text.lower() if self.lower or self.added else text
        if any(a in lower for a in self.added):
            return None
        return self.words(lower if self.lower else text)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _encode_whole(self, text: str) -> bytes:
        return self._packed(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that the young generation doesn't hold; it does afterwards."""
        tokenize, known, found = self.library.model.tokenize, self.old.get, {}
        for word in words:
            ids = known(word)
            if ids is None:
                ids = self._packed([t.id for t in tokenize(word.encode("utf-8").decode("latin-1").translate(_ALPHABET))])
            found[word] = ids
        if len(self.young) + len(found) > self.young_words:
            self.old, self.young = self.young, {}
        self.young.update(found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        waiting, new, known = [], set(), self.young.get
        for i, text in enumerate(texts):
            words = self._split(text)
            if words is None:
                out[i] = self._encode_whole(text)
                continue
            ids = list(map(known, words))
            if None in ids:
                missing = [k for k, found in enumerate(ids) if found is None]
                new.update([words[k] for k in missing])
                waiting.append((i, words, ids, missing))
            else:
                out[i] = b"".join(ids)
        found = self._encode_words(list(new))
        for i, words, ids, missing in waiting:
            for k in missing:
                ids[k] = found[words[k]]
            out[i] = b"".join(ids)
        return out


_encoders: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, added_tokens: bool = False, cache_words: int = CACHE_WORDS) -> Encoder:
    """This worker's encoder for a vocabulary file; it lives as long as the worker."""
    key = (path, added_tokens, cache_words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, added_tokens, cache_words)
    return _encoders[key]
