"""BPE encoding by forced boundaries, and decoding.

No merge ever joins two neighbouring symbols that stand side by side in no
token of the vocabulary, so the place between them is a certain cut. Words are
cut there by one look into a table per symbol pair; each fragment is merged by
itself, and the ids are concatenated. The vocabulary, its normaliser, its word
pattern and its added tokens come from a tokenizer file with a byte-level BPE
model, with or without a mark at word ends.

NULL and empty texts have no ids and decode to an empty text. Texts are taken
whole: a long one is one row of ids, and a fragment of any length is merged by
a heap. Repeated rows give repeated results, an empty table none; extra columns
stay, and one whose name a result takes is replaced.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veridect.llm.frames import ByteBoundCache, small_batches
from veridect.llm.tokens import UNUSUAL

#: Contractions that the word pattern names; on ASCII letters, digits and the rest it reads so.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_BYTES = 96 << 20
#: Text in one batch of work.
BATCH_BYTES = 2 << 20
#: Longer stretches without white space are not remembered.
CACHED_CHARS = 64
_NO_RANK = 1 << 40  # with a place of 20 bits behind it, still within 64
_SHIFT = 20


def byte_letters() -> list[str]:
    """The letter of each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(prints) else chr(next(others)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encodes and decodes many texts; one per worker process and vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE model")
        self.normalizer, self.pattern = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.suffix = model.get("end_of_word_suffix") or ""
        #: whether white space only separates, so that words between it can be remembered
        self.drops_space = WORD_PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") and bool(self.suffix)
        letters = byte_letters()
        self.bytes_of = {ord(c): b for b, c in enumerate(letters)}
        vocabulary = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = 1 + max([*vocabulary.values(), *self.added.values()])
        self.spelled: list[str] = [""] * size
        for token, number in [*vocabulary.items(), *self.added.items()]:
            self.spelled[number] = token
        self.byte_decoder = (spec["decoder"] or {}).get("type") == "ByteLevel"
        self.symbol = np.array([vocabulary[c] for c in letters] + [vocabulary[c + self.suffix] for c in letters], dtype=np.int64)
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {vocabulary[a] << _SHIFT | vocabulary[b]: r for r, (a, b) in enumerate(parts)}
        self.merged_ids = np.array([vocabulary[a + b] for a, b in parts], dtype=np.int64)
        self.pairs = np.array(sorted(self.rank), dtype=np.int64)
        self.pair_ranks = np.array([self.rank[p] for p in self.pairs.tolist()], dtype=np.int64)
        self.beside = self._beside(vocabulary)
        self.fragments = ByteBoundCache(CACHE_BYTES // 2)
        self.words = ByteBoundCache(CACHE_BYTES)

    def _symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, a word's last one raised by 256, and the places behind each word."""
        behind = np.cumsum([len(w) for w in words])
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.uint16)
        if self.suffix:
            symbols[behind - 1] += 256
        return symbols, behind

    def _beside(self, vocabulary: dict[str, int]) -> np.ndarray:
        """Whether two symbols stand side by side in any token."""
        out = np.zeros((512, 512), dtype=bool)
        for token in vocabulary:
            whole = bool(self.suffix) and token.endswith(self.suffix)
            data = self._bytes(token[: len(token) - len(self.suffix)] if whole else token)
            symbols = [*data[:-1], data[-1] + 256 * whole] if data else []
            out[symbols[:-1], symbols[1:]] = True
        return out

    def _bytes(self, spelled: str) -> bytes:
        return spelled.translate(self.bytes_of).encode("latin-1")

    def cuts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, the places behind each word, and where fragments start: at words and at certain cuts."""
        symbols, behind = self._symbols(words)
        start = np.ones(len(symbols), dtype=bool)
        start[1:] = ~self.beside[symbols[:-1], symbols[1:]]
        start[behind[:-1]] = True
        return symbols, behind, np.flatnonzero(start)

    def _merge(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of fragments, given as the bytes of their symbols."""
        long = [len(f) > 2 * CACHED_CHARS for f in fragments]
        short = iter(self._merge_together([f for f, is_long in zip(fragments, long, strict=True) if not is_long]))
        return [self._merge_long([int(i) for i in self.symbol[np.frombuffer(f, np.uint16)]]) if is_long else next(short) for f, is_long in zip(fragments, long, strict=True)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each two ids, or NO_RANK."""
        wanted = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at], _NO_RANK)

    def _merge_together(self, fragments: list[bytes]) -> list[bytes]:
        """Merges all fragments at once: in each round the first pair of least rank of every one that still has any."""
        out: list[bytes] = [b""] * len(fragments)
        if not fragments:
            return out
        ids = self.symbol[np.frombuffer(b"".join(fragments), np.uint16)]
        name = np.arange(len(fragments))
        start = np.cumsum([0, *(len(f) // 2 for f in fragments[:-1])])
        ends = np.zeros(len(ids), dtype=bool)
        ends[start[1:] - 1] = ends[-1] = True
        rank = np.append(self._ranks(ids[:-1], ids[1:]), _NO_RANK)
        rank[ends] = _NO_RANK
        while len(name):
            best = np.minimum.reduceat(rank << _SHIFT | np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids)))), start)
            place, least = (best & ((1 << _SHIFT) - 1)) + start, best >> _SHIFT
            open_ = least != _NO_RANK
            if not open_.all():
                stop = np.append(start[1:], len(ids))
                raw = ids.astype("<u4").tobytes()
                for i, p, q in zip(name[~open_].tolist(), start[~open_].tolist(), stop[~open_].tolist(), strict=True):
                    out[i] = raw[4 * p : 4 * q]
                keep = np.repeat(open_, stop - start)
                moved = np.cumsum(keep) - keep
                place, least, name = moved[place[open_]], least[open_], name[open_]
                ids, ends, rank, start = ids[keep], ends[keep], rank[keep], moved[start[open_]]
                if not len(name):
                    break
            ids[place], ends[place] = self.merged_ids[least], ends[place + 1]
            keep = np.ones(len(ids), dtype=bool)
            keep[place + 1] = False
            ids, ends, rank = ids[keep], ends[keep], rank[keep]
            # one symbol has gone from every fragment before
            place, start = place - np.arange(len(place)), start - np.arange(len(start))
            last = ends[place]
            rank[place[last]] = _NO_RANK
            inner = place[~last]
            rank[inner] = self._ranks(ids[inner], ids[inner + 1])
            behind = place[place > start]
            rank[behind - 1] = self._ranks(ids[behind - 1], ids[behind])
        return out

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same for one fragment, by a heap of (rank, place) over a linked list."""
        get, merged, n = self.rank.get, self.merged_ids.tolist(), len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << _SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << _SHIFT | ids[j]) != rank:
                continue
            ids[i], ids[j] = merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := get(ids[left] << _SHIFT | ids[after[left]])) is not None:
                    heapq.heappush(heap, (r, left))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _split(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        """Words of all stretches of text, as the file's normaliser and pattern give them, and the place behind each stretch's."""
        words: list[bytes] = []
        ends: list[int] = []
        wide = iter(self._split_wide([p for p in pieces if not p.isascii() or not self.drops_space]))
        for piece in pieces:
            if not self.drops_space or not piece.isascii():
                words += next(wide)
            elif piece.isalpha():
                words.append(piece.lower().encode())
            else:
                words += [w.encode() for w in ASCII_WORDS.findall(piece.lower())]
            ends.append(len(words))
        return words, ends

    def _split_wide(self, pieces: list[str]) -> list[list[bytes]]:
        """The same by the library; short stretches without white space go through it together."""
        short = [len(p) <= CACHED_CHARS and self.drops_space and not UNUSUAL.search(p) and len(p.split()) == 1 for p in pieces]
        normal = self.normalizer.normalize_str if self.normalizer else str
        joined = normal(" ".join([p for p, s in zip(pieces, short, strict=True) if s]))
        lengths = [len(w) for w in joined.split(" ")]
        together = len(lengths) == sum(short)
        behind = np.cumsum(np.array(lengths) + 1) - 1
        found = self.pattern.pre_tokenize_str(joined) if together else []
        first = np.searchsorted([at for _, (at, _) in found], behind).tolist()
        parts = [[self._bytes(w) for w, _ in found[a:b]] for a, b in zip([0, *first], first)]
        ready = iter(parts)
        return [next(ready) if s and together else [self._bytes(w) for w, _ in self.pattern.pre_tokenize_str(normal(p))] for p, s in zip(pieces, short, strict=True)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of stretches of text that no token spans."""
        words, ends = self._split(pieces)
        if not words:
            return [b""] * len(pieces)
        symbols, behind, start = self.cuts(words)
        raw, stop = symbols.tobytes(), [*start[1:].tolist(), len(symbols)]
        keys = [raw[2 * a : 2 * b] for a, b in zip(start.tolist(), stop, strict=True)]
        known = self.fragments
        known.settle()
        missing = known.unknown(set(keys))
        known.update(zip(missing, self._merge(missing), strict=True))
        out = list(map(known.__getitem__, keys))
        for key in keys:
            if len(key) > 2 * CACHED_CHARS:
                known.pop(key, None)
        places = np.searchsorted(start, np.concatenate([[0], behind])[[0, *ends]])
        return [b"".join(out[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        if not self.drops_space:
            return self._encode_pieces(texts)
        # the normaliser works within words, whose white space is plain
        cut = [None if UNUSUAL.search(t) else t.split() for t in texts]
        known = self.words
        known.settle()
        missing = known.unknown(set().union(*(words for words in cut if words)))
        known.update(zip(missing, self._encode_pieces(missing), strict=True))
        whole = iter(self._encode_pieces([t for t, words in zip(texts, cut, strict=True) if words is None]))
        out = [next(whole) if words is None else b"".join(map(known.__getitem__, words)) for words in cut]
        for word in missing:
            if len(word) > CACHED_CHARS:
                del known[word]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        if not self.added or not any(a in t for t in texts for a in self.added):
            return self._encode_plain(texts)
        parts = [self.added_pattern.split(t) for t in texts]
        coded = iter(self._encode_plain([p for part in parts for p in part[::2]]))
        number = {a: np.array([i], dtype="<u4").tobytes() for a, i in self.added.items()}
        return [b"".join(number[p] if k % 2 else next(coded) for k, p in enumerate(part)) for part in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; tokens stand apart by a space unless the file names a byte-level decoder."""
        tokens = map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if not self.byte_decoder:
            return " ".join(tokens)
        known = self.bytes_of
        return b"".join(self._bytes(t) if all(ord(c) in known for c in t) else t.encode() for t in tokens).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def bpe(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def _coded(df: DataFrame, column: str, results: dict[str, T.DataType], work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with result columns, worked out batch by batch; they take the place of columns of their names."""
    kept = [f for f in df.schema.fields if f.name not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column, BATCH_BYTES):
            columns = [batch.column(f.name) for f in kept] + work(batch.column(column))
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *results])

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, t) for n, t in results.items())]))


def _encoded(tool: ForcedBoundaryBpe, texts: pa.Array) -> tuple[list[bytes], list[pa.Array]]:
    ids = tool.encode(texts.to_pylist())
    return ids, [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]


def encode_documents(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` of ``column``."""
    return _coded(docs, column, {"ids": T.BinaryType(), "n_tokens": T.LongType()}, lambda texts: _encoded(bpe(path), texts)[1])


def decode_documents(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids in ``column``; NULL for NULL."""

    def work(ids: pa.Array) -> list[pa.Array]:
        tool = bpe(path)
        return [pa.array([None if i is None else tool.decode(i) for i in ids.to_pylist()], pa.string())]

    return _coded(encoded, column, {"decoded": T.StringType()}, work)


def round_trip(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``decoded`` in one pass, so that each task holds one copy of the vocabulary."""

    def work(texts: pa.Array) -> list[pa.Array]:
        tool = bpe(path)
        ids, arrays = _encoded(tool, texts)
        return [*arrays, pa.array([tool.decode(i) for i in ids], pa.string())]

    return _coded(docs, column, {"ids": T.BinaryType(), "n_tokens": T.LongType(), "decoded": T.StringType()}, work)
