"""Token ids of whole texts, with the ids of repeated words remembered inside a Python worker."""

from __future__ import annotations

import os
import re

import numpy as np

#: Words remembered by one worker; beyond that it starts anew (results do not depend on it).
REMEMBERED = 700_000
#: A full stop or comma between an ASCII letter and white space.
_STOP = re.compile(rb"[.,](?<=[a-z][.,])(?=\s)")
_ENCODERS: dict[str, "WordEncoder"] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(text: bytes) -> bytes:
    """The text with the same ids and fewer distinct words: the tokenizer lower-cases ASCII letters (done here
    unless combining marks follow some), and a stop behind a letter is a piece of its own in any case."""
    if b"\xcc" not in text and b"\xcd" not in text:
        text = text.lower()
    return _STOP.sub(rb" \g<0>", text)


class WordEncoder:
    """Ids by a BPE tokenizer that drops white space, so that a text's ids are its words' ids in a row.

    Each distinct word is encoded once. Many words go to the tokenizer in one call, with the digit 0 as a
    word of its own between them; words with that digit are encoded alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._ids("0")
        self.known: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        plain = []
        for w in words:
            if b"0" in w:
                self.known[w] = np.asarray(self._ids(w.decode()), "<u4").tobytes()
            else:
                plain.append(w)
        parts = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        joined = self.tokenizer.encode_batch_fast([" 0 ".join([w.decode() for w in part]) for part in parts], add_special_tokens=False)
        for part, encoded in zip(parts, joined):
            ids = np.asarray(encoded.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                for w in part:
                    self.known[w] = np.asarray(self._ids(w.decode()), "<u4").tobytes()
                continue
            firsts, lasts = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            data = ids.tobytes()
            for w, a, b in zip(part, firsts, lasts):
                self.known[w] = data[4 * a : 4 * b]

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [_plain(t).split() if t else [] for t in texts]
        fresh = set().union(*split) - self.known.keys()
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                # What these texts use stays, so frequent words are not encoded again.
                used = set().union(*split)
                self.known = {w: x for w, x in self.known.items() if w in used}
            self._learn(list(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary in a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
