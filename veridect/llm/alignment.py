"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Every token points to the token of the other vocabulary that holds its last
byte and so reaches farthest right; where both end together, the first
vocabulary's token is the end of the chain and points to itself. Doubling all
pointers until none changes takes every token to the last token of its group, a
stretch of bytes at whose edges both vocabularies cut.

Links are pairs of tokens whose bytes overlap. How often a pair of ids is linked
in the whole corpus is counted in two steps: tasks cut their documents into
slices of bounded size and count each slice's pairs, which are summed by pair;
the sums then come back to the slices that asked for them. So what is shuffled
are the different pairs of a slice, not its links, and nothing is broadcast but
the best count of each id of the second vocabulary, one row an id.

The first vocabulary is a byte-level BPE that gets a space and the text, the
second a sentencepiece model that adds the space itself. A text that is NULL,
empty or not rendered byte by byte by both has no tokens and zeros. Texts are
taken whole; memory grows with the longest one. Repeated rows are rows of their
own and count each time; an empty table gives none. Extra columns stay, unless
a result takes their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridect.llm.bpe import byte_letters
from veridect.llm.frames import ByteBoundCache, small_batches, stored
from veridect.llm.tokens import STRETCHES, certain, encoder

#: Bytes of text in one batch of array work, and in one slice of documents.
BATCH_BYTES = 1 << 20
SLICE_BYTES = 32 << 20
#: What a worker remembers of words.
CACHE_BYTES = 80 << 20
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
# Fixed value: the letter by which the pieces of sentencepiece write a space.
SPACE = "▁"


class PieceEncoder:
    """Ids of a sentencepiece BPE model with byte fallback.

    No piece goes on with a space behind another letter, holds a line feed, or
    has a letter next to something else, so a text falls apart at these places.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        kinds = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        mixed = [p for p in kinds if SPACE in p.lstrip(SPACE) or "\n" in p or any(a.isalpha() != b.isalpha() and a != SPACE for a, b in zip(p, p[1:]))]
        lead, feed = self.model.encode("\n")
        if mixed or self.table[lead] != b" " or self.table[feed] != b"\n":
            raise ValueError("pieces that hold letters next to spaces, line feeds or marks")

    def stretches(self, stretches: list[str], behind_space: bool) -> list[bytes]:
        """Ids of stretches that certain cuts set off, with the space they begin with, or without one."""
        texts = stretches if behind_space else ["\n" + s for s in stretches]
        skip = 0 if behind_space else 2
        return [np.array(ids[skip:], dtype="<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, before which the model puts a space."""
        return [np.array(ids, dtype="<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]


#: The entry of a stretch that either vocabulary does not render.
NOTHING = (b"", b"")


class PairCache(ByteBoundCache):
    """Two values an entry."""

    OVERHEAD = 300

    @staticmethod
    def contents(items: Iterable[tuple[str, tuple[bytes, bytes]]]) -> list[int]:
        return [len(key) + len(a) + len(b) for key, (a, b) in items]


class Aligner:
    """Both vocabularies and the array work on batches of texts."""

    def __init__(self, first: str, second: str):
        self.first, self.second = encoder(first, literal=True, cache_bytes=CACHE_BYTES // 8), PieceEncoder(second)
        if not self.first.spaces:
            raise ValueError("the first vocabulary must be byte-level")
        values = {ord(c): b for b, c in enumerate(byte_letters())}
        vocabulary = self.first.tokenizer.get_vocab()
        table = [b""] * (1 + max(vocabulary.values()))
        for token, number in vocabulary.items():
            table[number] = token.translate(values).encode("latin-1", "ignore")
        self.tables = table, self.second.table
        self.lengths = [np.array([len(t) for t in x], dtype=np.int64) for x in self.tables]
        self.width = len(self.second.table)
        most = len(str(max(map(len, self.tables))))
        self.digits = np.array([list(str(i).ljust(most + 1).encode()) for i in range(max(map(len, self.tables)))], dtype=np.uint8)
        self.digit_count = np.array([len(str(i)) for i in range(len(self.digits))])
        #: ids of both vocabularies by stretch
        self.known = PairCache(CACHE_BYTES)

    def _renders(self, side: int, ids: bytes, data: bytes) -> bool:
        return b"".join(map(self.tables[side].__getitem__, np.frombuffer(ids, "<u4").tolist())) == data

    def _learn(self, stretches: list[str]) -> None:
        for behind_space in (True, False):
            some = [s for s in stretches if (s[0] == " ") is behind_space and s[0] != "\n"]
            words = [s[1:] for s in some] if behind_space else some
            both = [self.first.stretches(words, behind_space), self.second.stretches(words, behind_space)]
            pairs = list(zip(*both, strict=True))
            if not all(self._renders(side, b"".join(ids), "".join(some).encode()) for side, ids in enumerate(both)):
                data = [s.encode() for s in some]
                pairs = [p if self._renders(0, p[0], d) and self._renders(1, p[1], d) else NOTHING for p, d in zip(pairs, data, strict=True)]
            self.known.update(zip(some, pairs, strict=True))
        for s in stretches:
            if s[0] == "\n":
                self.known[s] = (self.first.line_feeds(s), self.second.stretches([s], False)[0])

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both; none for texts that either does not render."""
        given = [t or "" for t in texts]
        cut = [STRETCHES.findall(" " + t) if t and certain(" " + t) else None for t in given]
        self.known.settle()
        self._learn(self.known.unknown(set().union(*(c for c in cut if c))))
        odd = [t for t, c in zip(given, cut, strict=True) if c is None]
        whole = zip(self.first(odd, spaced=True), self.second(odd), strict=True)
        get, out = self.known.__getitem__, ([], [])
        for t, stretches in zip(given, cut, strict=True):
            if stretches is None:
                a, b = next(whole)
                data = (" " + t).encode()
                if not t or not self._renders(0, a, data) or not self._renders(1, b, data):
                    a = b = b""
            else:
                pairs = list(map(get, stretches))
                a, b = b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])
                if NOTHING in pairs:
                    a = b = b""
            out[0].append(a)
            out[1].append(b)
        return out

    def align(self, coded: tuple[list[bytes], list[bytes]]) -> dict[str, np.ndarray]:
        """Groups and links of many texts laid end to end."""
        a, b = (np.frombuffer(b"".join(c), "<u4").astype(np.int64) for c in coded)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        n = len(a)
        to_b, to_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
        itself = np.arange(n)
        pointer = np.concatenate([np.where(end_b[to_b] > end_a, n + to_b, itself), to_a])
        while True:
            farther = pointer[pointer]
            if (farther == pointer).all():
                break
            pointer = farther
        last = pointer[:n] == itself
        number = np.cumsum(last) - 1
        group = number[pointer]
        begin = np.searchsorted(end_b, end_a - self.lengths[0][a], side="right")
        count = to_b - begin + 1
        start = np.cumsum(count) - count
        link_a = np.repeat(itself, count)
        link_b = np.arange(count.sum()) + np.repeat(begin - start, count)
        return {"a": a, "b": b, "group_a": group[:n], "group_b": group[n:], "last": last, "link_a": link_a, "link_b": link_b}

    def group_texts(self, x: dict[str, np.ndarray], rows_a: np.ndarray, n_rows: int) -> list[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2,b3 from a table of decimal digits."""
        groups = int(x["last"].sum())
        per_a, per_b = np.bincount(x["group_a"], minlength=groups), np.bincount(x["group_b"], minlength=groups)
        done_a, done_b = np.cumsum(per_a), np.cumsum(per_b)
        place_a = np.arange(len(x["a"])) + (done_b - per_b)[x["group_a"]]
        place_b = np.arange(len(x["b"])) + done_a[x["group_b"]]
        total = len(place_a) + len(place_b)
        ids, mark = np.empty(total, dtype=np.int64), np.full(total, ord(","), dtype=np.uint8)
        ids[place_a], ids[place_b] = x["a"], x["b"]
        mark[place_a[done_a - 1]] = ord("|")
        closing = place_b[done_b - 1]
        mark[closing] = ord(";")
        letters, size = self.digits[ids], self.digit_count[ids]
        letters[np.arange(total), size] = mark
        text = letters[np.arange(letters.shape[1]) <= size[:, None]].tobytes()
        behind = np.cumsum(size + 1)
        row = rows_a[np.flatnonzero(x["last"])]
        edge = np.searchsorted(row, np.arange(n_rows + 1))
        stops = np.concatenate([[0], behind[closing]])[edge].tolist()
        return [text[p : max(p, q - 1)] for p, q in zip(stops[:-1], stops[1:], strict=True)]

    def __call__(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """Per text: token, group and link counts, the groups, and its different pairs with their counts."""
        coded = self.encode(texts)
        rows, n_a, n_b = len(texts), *(np.array([len(c) // 4 for c in x], dtype=np.int64) for x in coded)
        if not n_a.sum():
            zeros = np.zeros(rows, dtype=np.int64)
            return {"n_a": n_a, "n_b": n_b, "n_groups": zeros, "n_links": zeros, "groups": [b""] * rows, "edges": np.zeros(rows + 1, np.int64), "keys": zeros[:0], "times": zeros[:0]}
        x = self.align(coded)
        row_a = np.repeat(np.arange(rows), n_a)
        link_row = row_a[x["link_a"]]
        pair = x["a"][x["link_a"]] * self.width + x["b"][x["link_b"]]
        size = len(self.tables[0]) * self.width
        different, times = np.unique(link_row * size + pair, return_counts=True)
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(row_a[x["last"]], minlength=rows),
            "n_links": np.bincount(link_row, minlength=rows),
            "groups": self.group_texts(x, row_a, rows),
            "edges": np.searchsorted(different, np.arange(rows + 1) * size),
            "keys": different % size,
            "times": times,
        }


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _slices(docs: DataFrame, first: str, second: str, groups: bool) -> DataFrame:
    """Rows of documents and rows of pair counts of each slice, written together."""
    kept = docs.schema["row"].dataType
    schema = (
        f"slice string, row {kept.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
        "pairs binary, times binary, pair long, n long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, part = aligner(first, second), TaskContext.get().partitionId()
        number = held = 0
        keys = times = np.zeros(0, dtype=np.int64)
        empty: dict[str, pa.DataType] = {}

        def table(count: int, **columns: pa.Array) -> pa.RecordBatch:
            columns["slice"] = pa.array([f"{part}-{number}"] * count, pa.string())
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(count, t) for c, t in empty.items()], list(empty))

        for batch in small_batches(batches, "text", BATCH_BYTES):
            if not empty:
                long, text, data = pa.int64(), pa.string(), pa.binary()
                empty = {"slice": text, "row": batch.schema.field("row").type, "n_a": long, "n_b": long, "n_groups": long, "n_links": long}
                empty |= {"groups_sha256": text, "groups": text, "pairs": data, "times": data, "pair": long, "n": long}
            column = batch.column("text")
            x = tool(column.to_pylist())
            own_keys, own_times = x["keys"].astype("<u8").tobytes(), x["times"].astype("<u4").tobytes()
            spans = list(zip(x["edges"][:-1].tolist(), x["edges"][1:].tolist(), strict=True))
            yield table(
                batch.num_rows,
                row=batch.column("row"),
                **{c: pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                groups_sha256=pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in x["groups"]]),
                **({"groups": pa.array([g.decode() for g in x["groups"]], pa.string())} if groups else {}),
                pairs=pa.array([own_keys[8 * p : 8 * q] for p, q in spans], pa.binary()),
                times=pa.array([own_times[4 * p : 4 * q] for p, q in spans], pa.binary()),
            )
            keys, times = _summed(np.concatenate([keys, x["keys"]]), np.concatenate([times, x["times"]]))
            held += column.nbytes
            if held >= SLICE_BYTES:
                yield table(len(keys), pair=pa.array(keys), n=pa.array(times))
                number, held, keys, times = number + 1, 0, keys[:0], times[:0]
        if len(keys):
            yield table(len(keys), pair=pa.array(keys), n=pa.array(times))

    return stored(docs.mapInArrow(run, schema), "alignment")


def _judged(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one slice (left) with the sums over their links' counts (right)."""
    order = np.argsort(right.column("pair").to_numpy())
    pair, total, best = (right.column(c).to_numpy()[order] for c in ("pair", "total", "is_best"))
    n_best, count_sum = [], []
    for batch in left.to_batches(max_chunksize=2000):
        keys = [np.frombuffer(p, "<u8").astype(np.int64) for p in batch.column("pairs").to_pylist()]
        times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
        edges = np.cumsum([0, *map(len, keys)])
        at = np.searchsorted(pair, np.concatenate(keys)) if len(keys) else edges[:0]
        for out, value in ((n_best, best), (count_sum, total)):
            sums = np.concatenate([[0], np.cumsum(times * value[at])])
            out.append(sums[edges[1:]] - sums[edges[:-1]])
    kept = left.drop_columns(["pairs", "times", "slice"])
    join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return kept.append_column("n_best", join(n_best)).append_column("count_sum", join(count_sum))


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair and total: how many links of the corpus hold a pair of ids."""
    return slices.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("total"))


def align_documents(docs: DataFrame, first: str, second: str, column: str = "text", groups: bool = True) -> DataFrame:
    """The columns of ``docs`` but the text, and ``RESULTS``.

    n_a and n_b tokens, n_groups, n_links, n_best (links whose pair is linked
    as often as any pair of its second id), count_sum (over the links, how often
    their pairs are linked in all), groups_sha256 and, with ``groups``, the
    groups as text: ids of both sides, a group's sides split by ``|``.
    """
    kept = [c for c in docs.columns if c not in (*RESULTS, column)]
    row = F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("_"))
    slices = _slices(docs.select(row.alias("row"), F.col(column).alias("text")), first, second, groups)
    width = _pieces(second)
    totals = stored(pair_counts(slices), "alignment-counts")
    # one row an id of the second vocabulary, so of a size that no corpus changes
    best = totals.groupBy((F.col("pair") % width).alias("b")).agg(F.max("total").alias("best"))
    counts = (
        slices.filter("pair IS NOT NULL")
        .select("slice", "pair")
        .join(totals, "pair")
        .withColumn("b", F.col("pair") % width)
        .join(F.broadcast(best), "b")
        .select(F.col("slice").alias("asked_by"), "pair", "total", (F.col("total") == F.col("best")).cast("long").alias("is_best"))
    )
    measured = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else [])]
    rows = slices.filter("pair IS NULL")
    linked = rows.filter("n_links > 0").select("slice", *measured, "pairs", "times")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in linked.select(*measured).schema.fields)
    judged = linked.groupBy("slice").cogroup(counts.groupBy("asked_by")).applyInArrow(_judged, f"{schema}, n_best long, count_sum long")
    none = rows.filter("n_links = 0").select(*measured, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return judged.unionByName(none).select(*([F.col("row")[c].alias(c) for c in kept]), *[c for c in RESULTS if groups or c != "groups"])


def _pieces(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()
