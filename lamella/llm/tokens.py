"""Word-wise use of a tokenizer file.

A text may be cut between a character that is surely no white space (printable ASCII, or Latin letters up to U+024F)
and a following space or line feed: the pre-tokenizers of the supported files never let a token reach across such a
place, nor look behind it, so the pieces' ids, one after the other, are the text's. Special tokens in the files hold no space.
Texts of ASCII and Latin letters alone may also be cut after any letter that is followed by none, as no token goes on there.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Where Spark and Python may cut; the pattern means the same to both.
CUT = "(?<=[!-~¡-ɏ])(?=[ \n])"
split, _next_cut = re.compile(CUT).split, re.compile(CUT).search
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_fine = re.compile(f"[ \n]*[{_LETTER}]+|[ \n]*[^ \n{_LETTER}]+[{_LETTER}]*|[ \n]+").findall
_odd = re.compile(f"[^\n -~{_LETTER}]").search
#: Words that a cache holds before it starts afresh, and the longest that it keeps.
CACHED_WORDS, LONGEST_CACHED = 400_000, 64
_AT_ONCE, _JOINED = 20_000, 100
#: Characters of a text that are cut into words at once.
STRETCH = 1 << 18
#: Stands between words that are encoded together, as a token of its own.
_MARK = "~"


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str, bare: bool = False):
    """The tokenizer of a file, without truncation and padding, on one thread; ``bare``: without its normalizer too."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    if bare:
        own.normalizer = None
    return own


def encode_words(tokenizer, words: list[str]) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers.

    Words that begin, but don't end, with a space or line feed go together, with a marked place after each, which saves
    most of the cost of a call; a word that could touch the mark or a special token goes on its own.
    """
    out: list[bytes | None] = [None] * len(words)
    mark = tokenizer.encode(f" {_MARK}", add_special_tokens=False).ids
    plain = [k for k, w in enumerate(words) if w[:1] in " \n" and len(w) <= LONGEST_CACHED and w[-1:] > " " and w.isprintable() and _MARK not in w and "<|" not in w] if len(mark) == 1 else []
    for k in range(0, len(plain), _AT_ONCE):
        some = [plain[i : i + _JOINED] for i in range(k, min(k + _AT_ONCE, len(plain)), _JOINED)]
        joined = ["".join([f"{words[i]} {_MARK}" for i in own]) for own in some]
        for own, e in zip(some, tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == mark[0])
            if len(ends) == len(own):
                raw, begin = ids.tobytes(), 0
                for i, end in zip(own, (4 * ends).tolist(), strict=True):
                    out[i] = raw[begin:end]
                    begin = end + 4
    rest = [k for k, found in enumerate(out) if found is None]
    for k in range(0, len(rest), _AT_ONCE):
        own = rest[k : k + _AT_ONCE]
        for i, e in zip(own, tokenizer.encode_batch_fast([words[i] for i in own], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
    return out


def pieces(text: str, fold: bool = False) -> list[str]:
    """A text in pieces as small as is safe; ``fold`` lower-cases them, for a tokenizer that would do so itself."""
    if "<|" in text or _odd(text):
        return split(text)
    return _fine(text.lower() if fold else text)


def stretches(text: str, size: int) -> Iterator[str]:
    """A text in stretches of about ``size`` characters, cut where no token crosses; one stretch if there is no such place."""
    begin = 0
    while len(text) - begin > size and (cut := _next_cut(text, begin + size)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


class WordCache:
    """Encodes whole texts, each word once for as long as the cache holds it."""

    def __init__(self, path: str):
        self.tokenizer, self.bare, self.known = load(path), load(path, True), {}
        with open(path, encoding="utf-8") as f:
            self.fold = '"Lowercase"' in json.dumps(json.load(f)["normalizer"])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; a long one goes by stretches, as its words as Python objects take many times its room."""
        if any(t and len(t) > STRETCH for t in texts):
            return [b"".join(self._encode([s])[0] for s in stretches(t, STRETCH)) if t and len(t) > STRETCH else self._encode([t])[0] for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        words = [pieces(t, self.fold) if t else [] for t in texts]
        new = list(set().union(*words).difference(self.known))
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known = {}
            new = list(set().union(*words))
        known = self.known
        # Lower-case Latin words are as the normalizer would leave them, but for white space, which is dropped.
        plain = {w for w in new if not _odd(w) and w.lower() == w} if self.fold else set()
        for tokenizer, own in ((self.bare, list(plain)), (self.tokenizer, [w for w in new if w not in plain])):
            known.update(zip(own, encode_words(tokenizer, own), strict=True))
        out = [b"".join(map(known.__getitem__, w)) for w in words]
        for w in new:
            if len(w) > LONGEST_CACHED:
                del known[w]
        return out
