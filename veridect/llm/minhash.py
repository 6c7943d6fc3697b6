"""Near-duplicate classes by ProbMinHash over weighted word shingles.

Weight of a shingle: 1 + ln(its count). Each shingle is a Poisson process whose
rate is its weight; an arrival carries a time and a random register, a register
keeps the first arrival, and a process ends when its time is past the latest
register. Equal registers estimate the probability Jaccard of two texts. Bands
of registers give candidate groups, and every candidate link is verified with
the exact probability Jaccard of the two texts.

Texts with equal shingle counts are one node. In a candidate group, the node
with the least key is compared with all others; in groups that still hold several
components, all pairs across components follow. Pairs are left out only if
``marks`` or ``profiles`` prove that they are not similar enough; ``marks`` do so
inside the join, which gives a pair once, in the first band that it shares. So the verified links span
the classes; they are not all links between similar texts. Links join
into classes by alternating large-star and small-star steps on distributed
tables.

Defined cases: a NULL or wordless text is a class of its own row. Texts of
fewer than ``words`` words have one shingle of all their words. Repeated rows
and equal texts share a class, also when ids repeat. ``class_id`` is the least
id of the class; classes of rows without an id have a NULL class. An empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridect.llm import hashing
from veridect.llm.frames import make_room, small_batches, stored

GOLDEN = np.uint64(hashing.BASE)
# bytes of text that a task looks at together: its arrays take about eighty times as much
BATCH_BYTES = 1 << 20


def weighted_shingles(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order: (text number, hash, count)."""
    owner, shingle = hashing.shingles(*hashing.words(texts), words)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return owner[first], shingle[first], np.diff(np.append(first, len(owner)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers matrix of the shingle that arrived first in each register."""
    times = np.full(n * registers, np.inf)
    first = np.zeros(n * registers, dtype=np.uint64)
    clock = np.zeros(len(owner))
    element = shingle
    while len(owner):
        random = hashing.mix(element := element + GOLDEN)
        clock = clock - np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight
        slot = owner * registers + (hashing.mix(random) % np.uint64(registers)).astype(np.int64)
        early = clock < times[slot]
        np.minimum.at(times, slot[early], clock[early])
        won = early & (times[slot] == clock)
        first[slot[won]] = shingle[won]
        late = times.reshape(n, registers).max(axis=1)
        go = clock < late[owner]
        owner, shingle, element, weight, clock = owner[go], shingle[go], element[go], weight[go], clock[go]
    return first.reshape(n, registers)


def probability_jaccard(a: dict[int, float], b: dict[int, float]) -> float:
    """Sum over shared elements d of 1 / sum over all e of max(a_e / a_d, b_e / b_d)."""
    shared = a.keys() & b.keys()
    if not shared:
        return 0.0
    keys = np.array(list(a.keys() | b.keys()), dtype=np.uint64).tolist()
    x = np.array([a.get(k, 0.0) for k in keys])
    y = np.array([b.get(k, 0.0) for k in keys])
    both = np.flatnonzero((x > 0) & (y > 0))
    # equal ratios of the two weights give equal sums up to a factor, so each ratio is summed once
    ratio, back = np.unique(y[both] / x[both], return_inverse=True)
    sums = np.array([np.maximum(x, y / r).sum() for r in ratio])
    return float((x[both] / sums[back]).sum())


PARTS = 128


def profiles(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of each text's weight in ``PARTS`` parts of the hash space, rounded up to bytes; value of one unit.

    A shared element d adds at most min(x_d / sum(x), y_d / sum(y)) to the
    probability Jaccard, so the sum of the lesser shares bounds it from above.
    """
    part = owner * PARTS + (hashing.mix(shingle) % np.uint64(PARTS)).astype(np.int64)
    sums = np.bincount(part, weight, minlength=n * PARTS).reshape(n, PARTS)
    shares = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
    unit = np.maximum(shares.max(axis=1, initial=0) / 255, 1e-300) * (1 + 1e-9)
    return np.ceil(shares / unit[:, None]).astype(np.uint8), unit


MARK_WORDS = 16


def marks(owner: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """n x ``MARK_WORDS`` matrix of bits that say in which of as many parts of the hash space a text has an odd number of shingles.

    Where two texts' bits differ, one has a shingle that the other lacks, so the
    number of such bits bounds from below how many shingles they do not share.
    """
    place = hashing.mix(shingle) % np.uint64(64 * MARK_WORDS)
    bits = np.zeros(n * MARK_WORDS, dtype=np.uint64)
    np.bitwise_xor.at(bits, owner * MARK_WORDS + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return bits.view(np.int64).reshape(n, MARK_WORDS)


def _meeting(rest: DataFrame, similarity: float) -> DataFrame:
    """Pairs of nodes of different components that share a band, without those whose marks prove them unlike.

    Scaling does not change the probability Jaccard, and 1 / sum of max(x_e / x_d,
    y_e / y_d) is at most max(x_d, y_d) / sum of max(x_e, y_e). So it is at most
    S / (S + U), where S sums max(x_d, y_d) over shared elements and U the weights
    of the others. Weights are 1 or more, so with N elements and weights of T in
    both texts, S <= T - N / 2 - U / 2, and U is at least the number D of marks
    that differ: the similarity is at most (2 T - N - D) / (2 T - N + D).
    """
    columns = [c for c in rest.columns if c != "band"]
    name = lambda c, x: {"node": x, "root": "r" + x}.get(c, f"{c}_{x}")
    one, two = (rest.select(F.col("band").alias(f"band_{x}"), *(F.col(c).alias(name(c, x)) for c in columns)) for x in "ab")
    differ = " + ".join(f"bit_count(marks_a[{i}] ^ marks_b[{i}])" for i in range(MARK_WORDS))
    unlike = f"({differ}) * (1D + {similarity}D) > (2D * (total_a + total_b) - (size_a + size_b)) * (1D - {similarity}D) + 1e-6D"
    first = "array_intersect(bands_a, bands_b)[0] = band_a"
    return one.join(two, F.expr(f"band_a = band_b AND ra < rb AND NOT ({unlike}) AND {first}")).select(
        "a", "b", "profile_a", "unit_a", "profile_b", "unit_b"
    )


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose profiles leave room for the similarity."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (
                np.frombuffer(b"".join(batch.column(f"profile_{x}").to_pylist()), np.uint8).reshape(-1, PARTS)
                * batch.column(f"unit_{x}").to_numpy()[:, None]
                for x in "ab"
            )
            keep = np.minimum(one, two).sum(axis=1) >= similarity - 1e-6
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "profile_a", "unit_a", "profile_b", "unit_b").mapInArrow(bound, "a binary, b binary")


#: Columns that tell of a node that it is unlike another.
SKETCH = ["profile", "unit", "marks", "size", "total"]


def _nodes(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Row key, node, band keys and sketch of each document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("near_duplicates")
        for batch in small_batches(batches, "t", BATCH_BYTES):
            texts = [None if t is None else t.encode() for t in batch.column("t").to_pylist()]
            n = len(texts)
            owner, shingle, count = weighted_shingles(texts, words)
            weight = 1 + np.log(count)
            kept = signatures(owner, shingle, weight, n, bands * rows)
            profile, unit = profiles(owner, shingle, weight, n)
            keys = np.zeros((n, bands), dtype=np.uint64)
            for k in range(rows):
                keys = hashing.mix(keys * GOLDEN + kept[:, k::rows])
            keys = hashing.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN).astype(np.int64)
            bounds = np.searchsorted(owner, np.arange(n + 1))
            node = [
                hashlib.blake2b(shingle[s:e].tobytes() + count[s:e].tobytes(), digest_size=16).digest() if e > s else None
                for s, e in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(node, pa.binary()),
                    pa.array([None if v is None else k for v, k in zip(node, keys, strict=True)], pa.list_(pa.int64())),
                    pa.array([p.tobytes() for p in profile], pa.binary()),
                    pa.array(unit),
                    pa.array(list(marks(owner, shingle, n)), pa.list_(pa.int64())),
                    pa.array(np.bincount(owner, minlength=n), pa.int64()),
                    pa.array(np.bincount(owner, weight, minlength=n), pa.float64()),
                ],
                names=["doc_id", "text_key", "node", "bands", *SKETCH],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "bands array<bigint>, profile binary, unit double, marks array<bigint>, size long, total double"
    return docs.mapInArrow(sketch, f"doc_id {kind}, text_key long, node binary, {columns}")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("near_duplicates")
        for batch in small_batches(small_batches(batches, "ta", BATCH_BYTES), "tb", BATCH_BYTES):
            keep = []
            one, two = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            number = {t: i for i, t in enumerate(dict.fromkeys([*one, *two]))}
            owner, shingle, count = weighted_shingles([t.encode() for t in number], words)
            bounds = np.searchsorted(owner, np.arange(len(number) + 1))
            weight = 1 + np.log(count)
            for x, y in zip(map(number.get, one), map(number.get, two), strict=True):
                x, y = slice(*bounds[x : x + 2]), slice(*bounds[y : y + 2])
                _, i, j = np.intersect1d(shingle[x], shingle[y], assume_unique=True, return_indices=True)
                # bounds the similarity from above, as in ``profiles``
                if np.minimum(weight[x][i] / weight[x].sum(), weight[y][j] / weight[y].sum()).sum() < similarity - 1e-6:
                    keep.append(False)
                    continue
                a, b = (dict(zip(shingle[z].tolist(), weight[z].tolist(), strict=True)) for z in (x, y))
                keep.append(probability_jaccard(a, b) >= similarity - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    one = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a binary, b binary")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of each connected component, for nodes that have a link."""
    edges = stored(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").filter("u <> v").distinct(), name)
    before = None
    while True:
        both = edges.union(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").selectExpr("v as u", "m as v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").selectExpr("v as u", "m as v").filter("u <> v").union(root.selectExpr("u", "m as v")).distinct()
        edges = stored(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.selectExpr("u as node", "v as root")
        before = now


def _classes_and_links(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    bands: int = 32,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Results of ``near_duplicate_classes`` and ``spanning_links``."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    keyed = named.withColumn("text_key", F.xxhash64("t"))
    rows_ = stored(_nodes(keyed, words, bands, rows), "sketches")
    # one row stands for all that share a node
    nodes = rows_.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key", "bands", *SKETCH)).alias("m")).select("node", "m.*")
    nodes = stored(nodes, "nodes")
    members = nodes.select("node", F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("band", "hub")
    groups = stored(members.join(hubs, "band"), "groups")
    stars = groups.filter("node <> hub").selectExpr("hub as a", "node as b").distinct()

    involved = groups.select("node").distinct()
    reps = nodes.join(involved, "node").select("node", F.col("doc_id").alias("rep"), "text_key")
    # min(struct) may choose a row without id: compare null-safe
    texts = keyed.join(reps, (keyed.text_key == reps.text_key) & keyed.doc_id.eqNullSafe(reps.rep)).select("node", "t")
    texts = stored(texts.dropDuplicates(["node"]), "texts")
    links = stored(_verified(stars, texts, words, similarity), "links")

    roots = components(links)
    held = groups.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = held.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    rest = held.join(mixed, "band").join(nodes.select("node", "bands", *SKETCH), "node")
    met = _possible(_meeting(rest, similarity), similarity)
    across = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stored(_verified(across.join(stars, ["a", "b"], "left_anti"), texts, words, similarity), "links")
    links = links.union(more)
    if not more.isEmpty():
        roots = components(links)

    one, two = (nodes.selectExpr(f"node as {x}", f"doc_id as doc_{x}", f"text_key as text_key_{x}") for x in "ab")
    pairs = links.join(one, "a").join(two, "b").select("doc_a", "text_key_a", "doc_b", "text_key_b")
    rooted = (
        rows_.select("doc_id", "text_key", "node")
        .join(nodes.select("node").join(roots, "node", "left"), "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    classes = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    alone = F.col("root").isNull()
    members = rooted.join(classes, "root", "left").select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_rows")).cast("long").alias("class_rows"),
        (~alone).alias("has_words"),
        "root",
    )
    return members, pairs


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_key (hash of the text), class_id, class_rows, has_words, root (tells classes apart, NULL if wordless)."""
    return _classes_and_links(docs, **options)[0]


def spanning_links(docs: DataFrame, **options) -> DataFrame:
    """doc_a, text_key_a, doc_b, text_key_b: verified pairs of different texts that join them into classes.

    One row stands for all with its shingle counts. Not all similar pairs are among the links.
    """
    return _classes_and_links(docs, **options)[1]


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each class the row with the least id stays, wordless rows all stay."""
    found = stored(near_duplicate_classes(docs, **options), "classes")
    text_col, id_col = options.get("text_col", "text"), options.get("id_col", "doc_id")
    # the least id, as class_id; without any id the least text
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = found.filter("has_words").groupBy("root").agg(F.min(place).alias("m"))
    chosen = first.select(F.col("m.doc_id").alias("__id"), F.col("m.text_key").alias("__key"))
    wordless = found.filter("not has_words").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumn("__text_key", F.xxhash64(text_col))
    match = (F.col("__text_key") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id"))
    kept = keyed.join(chosen, match).drop("__id", "__key")
    # equal rows (same id and text) cannot be told apart: keep one of them
    repeated = not found.filter("has_words").groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()
    if repeated:
        kept = kept.dropDuplicates([id_col, "__text_key"])
    return kept.union(keyed.join(wordless, match, "left_semi")).drop("__text_key")
