"""BPE encoding and decoding of whole texts by batched merge rounds (operator 11).

The symbols of all words that a task has not met before lie in one flat array.  A round forms the key of every adjacent
pair, finds its rank by binary search in the sorted pair keys, and merges, in every word at once, the pairs of that word's
lowest rank, from the left.  Words without a pair left leave the array.  In words of more than ``LONG`` symbols the
lowest rank is that of a window instead of the word: a merge can only be affected by pairs nearer than the longest
token, so distant parts of a long word go on independently and the number of rounds does not grow with its length.

Texts are cut at ASCII white space into chunks, which the tokenizer would never merge across; a worker keeps the ids of
chunks up to ``CACHE_BYTES``.  Normalisation and pre-tokenization of chunks beyond ASCII are those of the tokenizer file.
No shuffle takes place and a task holds one Arrow batch and one slice of ``SLICE`` bytes of text.

Defined results: null and empty texts have no ids and decode to the empty string; strings of added tokens in a text
become their ids, as in the library; rows are independent, so ties, repeated rows and null doc_ids give a row each; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.tokens import default_tokenizer

#: Estimated bytes of cached chunks in one Python worker.
CACHE_BYTES = 96 << 20
#: Python's own bytes for one cached chunk, roughly.
ENTRY = 200
#: Bytes of text that are encoded together.
SLICE = 1 << 20
#: Symbols above which a word is merged by windows.
LONG = 256
NONE = np.iinfo(np.int64).max
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def sliding_min(x: np.ndarray, reach: int) -> np.ndarray:
    """The least value within ``reach`` places of every place."""
    side = np.full(reach, NONE)
    m, span, whole = np.concatenate([side, x, side]), 1, 2 * reach + 1
    while span < whole:
        step = min(span, whole - span)
        m = np.minimum(m[:-step], m[step:])
        span += step
    return m


class Merges:
    """Merge rules as sorted pair keys with the rank and the result of each."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.base = max(vocab.values()) + 1
        left, right, made = (np.array([vocab[t] for t in side], np.int64) for side in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.append(order, NONE), made[order]
        born = np.full(self.base, -1, np.int64)
        born[made] = np.arange(len(made))
        # Equal pairs may be merged together if a token comes from one rule and is used by later rules only.
        if len(np.unique(made)) != len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("merge rules have to be in the order in which their tokens arise")
        self.reach = max(map(len, vocab))

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each); ``symbols`` are those of all words one after another."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        long = lengths[word] > LONG
        parts = [self._rounds(symbols[use], word[use], windows) for use, windows in ((~long, False), (long, True)) if use.any()]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        sym, word = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(lengths))

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place in the sorted keys of the pair of each symbol in ``at`` with the next one of its word; len(keys) where no rule has it."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * self.base + sym[after]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[place] == key) & (word[at] == word[after]) & (after > at), place, len(self.keys))

    def _rounds(self, sym: np.ndarray, word: np.ndarray, windows: bool) -> tuple[np.ndarray, np.ndarray]:
        done_sym, done_word = [], []
        at = self._pairs(sym, word, np.arange(len(sym)))
        while len(sym):
            rank = self.ranks[at]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(first, append=len(word))
            least = np.minimum.reduceat(rank, first)
            open_ = least != NONE
            if not open_.all():
                left = np.repeat(open_, size)
                done_sym.append(sym[~left])
                done_word.append(word[~left])
                sym, word, rank, at, least, size = sym[left], word[left], rank[left], at[left], least[open_], size[open_]
                if not len(sym):
                    break
            bound = sliding_min(rank, self.reach) if windows else np.repeat(least, size)
            low = (rank == bound) & (rank != NONE)
            start = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))  # of runs of one pair, such as a a a
            length = np.diff(start, append=len(rank))
            within = np.arange(len(rank)) - np.repeat(start, length)
            pick = np.flatnonzero(np.repeat(np.logical_and.reduceat(low, start), length) & (within % 2 == 0))
            sym[pick] = self.made[at[pick]]
            stays = np.ones(len(sym), bool)
            stays[pick + 1] = False
            sym, word, at = sym[stays], word[stays], at[stays]
            now = pick - np.arange(len(pick))
            changed = np.concatenate([now, now[now > 0] - 1])
            at[changed] = self._pairs(sym, word, changed)
        return np.concatenate(done_sym), np.concatenate(done_word)


class Codec:
    """ids of texts in UTF-8 and texts of ids, for a tokenizer file of byte-level BPE with word ends."""

    kept: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        if model["type"] != "BPE" or given["decoder"] is not None or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "dropout")):
            raise ValueError("not a byte-level BPE file with word ends")
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.merges = Merges(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        added = {t["content"]: t["id"] for t in given["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in given["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        self.added = {k.encode(): np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.cut = re.compile(b"|".join(re.escape(k) for k in sorted(self.added, key=len, reverse=True))) if added else None
        self.strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            self.strings[i] = token.encode()
        one_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = sorted(c for c in vocab if len(c) == 1)
        self.inner, self.last = np.full(0x200, -1, np.int64), np.full(0x200, -1, np.int64)
        for c in letters:
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + suffix]
        self.shown = {b: one_byte.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        self.cache: dict[bytes, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, path: str) -> "Codec":
        """The worker's own instance; it outlives the task."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def words(self, chunk: bytes) -> list[str]:
        """The chunk's words as the pre-tokenizer writes them, one letter a byte."""
        text = chunk.decode("utf-8", "replace")
        if text.isascii():
            return [w if w.isalnum() else w.translate(self.shown) for w in _ASCII_WORDS.findall(text.lower())]
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def encode_chunks(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks without ASCII white space, all merged together."""
        if not chunks:
            return {}
        words = [self.words(c) for c in chunks]
        flat = [w for ws in words for w in ws]
        per_chunk = np.array([len(ws) for ws in words], np.int64)
        lengths = np.array([len(w) for w in flat], np.int64)
        letters = np.frombuffer("".join(flat).encode("utf-32-le"), "<u4")
        symbols = self.inner[letters]
        ends = np.cumsum(lengths)  # no word is empty
        symbols[ends - 1] = self.last[letters[ends - 1]]
        ids, counts = self.merges.run(symbols, lengths)
        code = ids.astype("<u4").tobytes()
        at = 4 * np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(per_chunk))]
        return {c: code[i:j] for c, i, j in zip(chunks, at[:-1].tolist(), at[1:].tolist())}

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts; the new chunks of about SLICE bytes of text are merged together."""
        parts: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, int, list[bytes]]] = []  # text, place among its parts, chunks
        size = 0
        for i, text in enumerate(texts):
            at = 0
            for m in self.cut.finditer(text) if self.cut else ():
                for part in slices(text[at : m.start()]):
                    waiting.append((i, len(parts[i]), part.split()))
                    parts[i].append(b"")
                parts[i].append(self.added[m[0]])
                at = m.end()
            for part in slices(text[at:] if at else text):
                waiting.append((i, len(parts[i]), part.split()))
                parts[i].append(b"")
                size += len(part)
                if size >= SLICE:
                    self._fill(waiting, parts)
                    waiting, size = [], 0
        self._fill(waiting, parts)
        return [b"".join(p) for p in parts]

    def _fill(self, waiting: list[tuple[int, int, list[bytes]]], parts: list[list[bytes]]) -> None:
        found = self.encode_chunks(list(set().union(*(chunks for _, _, chunks in waiting)).difference(self.cache)))
        more = sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)
        if self.held + more <= CACHE_BYTES:
            self.held += more
            self.cache.update(found)
        known = self.cache.get
        for i, at, chunks in waiting:
            ids = list(map(known, chunks))
            if None in ids:
                ids = [found[c] if x is None else x for c, x in zip(chunks, ids)]
            parts[i][at] = b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids: their strings with a blank between each two."""
        numbers, step = np.frombuffer(ids, "<u4"), SLICE // 4
        return b" ".join(b" ".join(map(self.strings.__getitem__, numbers[i : i + step].tolist())) for i in range(0, len(numbers), step))


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of about SLICE bytes, cut at white space only."""
    at = 0
    while len(text) - at > SLICE:
        gap = _SPACE.search(text, at + SLICE)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def _mapped(df: DataFrame, column: str, kind: pa.DataType, make, names: dict[str, pa.DataType], path: str | None) -> DataFrame:
    """doc_id and what ``make(codec, values)`` gives for each of ``names``."""
    path = path or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), *names.items()])
    spark_kinds = {pa.binary(): "binary", pa.string(): "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            rows = make(codec, [v or b"" for v in batch.column(1).to_pylist()])
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(names.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    given = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("binary").alias("given"))
    return given.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {spark_kinds[k]}" for n, k in names.items())]))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit numbers) of every text."""
    return _mapped(docs, "text", pa.binary(), lambda codec, texts: [(ids,) for ids in codec.encode_many(texts)], {"ids": pa.binary()}, path)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of every row of doc_id, ids."""
    return _mapped(encoded, "ids", pa.string(), lambda codec, ids: [(codec.decode(v).decode(),) for v in ids], {"text": pa.string()}, path)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: encode and decode in one pass over the texts."""

    def both(codec: Codec, texts: list[bytes]) -> list[tuple[bytes, str]]:
        return [(ids, codec.decode(ids).decode()) for ids in codec.encode_many(texts)]

    return _mapped(docs, "text", pa.binary(), both, {"ids": pa.binary(), "decoded": pa.string()}, path)


def digests(trips: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows of ``round_trip``."""
    return trips.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
