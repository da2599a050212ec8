"""Token ids of whole texts through a public tokenizer file, cached per word.

The word tokenizer lower-cases, composes characters and splits at white space before merging, so a
text's ids are those of its space-separated words one after another.  Each Python worker keeps the
ids of the words it met first as little-endian bytes; when that table is full, further words are
encoded anew for each text.
"""

from __future__ import annotations

import os

import numpy as np

CACHE_WORDS = 800_000
EMPTY = b""
#: Stands between words that are encoded together.
MARK = b"\x01"
_TO_SPACE = bytes.maketrans(b"\n\t\r", b"   ")

_kept: dict[tuple[str, str], "WordIds"] = {}


class WordIds:
    """ids(text) as little-endian bytes of ``dtype``; equal to encoding the whole text at once."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size() - 1 > np.iinfo(self.dtype).max:
            raise ValueError(f"{self.tokenizer.get_vocab_size()} ids do not fit {self.dtype}")
        self.cache: dict[bytes, bytes] = {EMPTY: EMPTY}

    @classmethod
    def of(cls, path: str, dtype: str = "<u4") -> "WordIds":
        """The worker's own instance; it outlives the task."""
        if (path, dtype) not in _kept:
            _kept[path, dtype] = cls(path, dtype)
        return _kept[path, dtype]

    def ids(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8; A-Z are lower-cased here already, which the tokenizer does anyway."""
        words = text.lower().translate(_TO_SPACE).split(b" ")
        ids = list(map(self.cache.get, words))
        if None in ids:
            holes = [i for i, x in enumerate(ids) if x is None]
            missing = list({words[i] for i in holes})
            found = self._encode(missing)
            for i in holes:
                ids[i] = found[words[i]]
            if len(self.cache) + len(found) <= CACHE_WORDS:
                self.cache.update(found)
        return b"".join(ids)

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Many words in one call: they are joined by a mark that is a token of its own, and cut there again."""
        found, plain = {}, []
        for word in words:
            if MARK in word:
                found[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, self.dtype).tobytes()
            else:
                plain.append(word)
        if plain:
            text = (b" " + MARK + b" ").join(plain).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            at = np.flatnonzero(ids == self.mark)
            code, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            for word, i, j in zip(plain, [0, *((at + 1) * size).tolist()], [*(at * size).tolist(), len(code)]):
                found[word] = code[i:j]
        return found


def default_tokenizer() -> str:
    """The word tokenizer of the installed public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
