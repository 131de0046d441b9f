"""Near-duplicate texts with small edits, found through Golay-code fuzzy hashing.

Every distinct text gets a fingerprint of :data:`SEGMENTS` segments of 23 bits. A segment
holds one bit of each of 23 one-permutation min-hashes of the text's distinct 3-character
pieces, so two texts of similarity J differ in a bit with probability (1-J)/2. A segment
is decoded to the Golay codewords nearby (one or six), and each of their
indices, with two whole min-hashes of the text as anchors, becomes a key. The errors of a pair spread over
the segments, so some segment has few (pigeonhole), and there the pair meets in a key: at
similarity 0.7 a segment's keys meet with probability 0.61 and the anchors with 0.49, hence a
pair at exactly 0.7 is missed with probability 0.7**18 < 0.002, at 0.75 with 0.0001; short texts, whose bits are fewer, with somewhat more.

Meeting pairs are filtered on the fly by set size and a 240-bit sketch that travels with the keys,
and the rest is verified exactly on the texts. Exact copies become one text first (with partial aggregation, so
a text that a third of all rows share is no hot key) and are expanded only in the result that asks for pairs of rows.

Plan: one numpy pass over the distinct texts (linear), one shuffle of the keys, one join; no group
is ever collected, and skewed keys are left to the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import golay
from docmill.sources.tables import materialize

#: Segments of the fingerprint, characters per piece, and the similarity that counts.
SEGMENTS, GRAM, THRESHOLD = 18, 3, 0.7
#: Sketch: bits kept beside the 16 bits of the set's size, and the most that may differ.
#: At similarity 0.7 they differ in 36 +- 5.5 places; 59 is 4.3 deviations away: one pair in 100,000 at just 0.7 is lost to it, far fewer than to the keys.
SKETCH_BITS, SKETCH_MOST = 240, 59
_LONGS = ("s1", "s2", "s3", "s4")
SIZE_MOST = 65535
#: Characters handled at once inside a task.
SLICE = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20310607))
_MUL = _RNG.integers(1, 1 << 63, (SEGMENTS, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Code points of white space (str.isspace()).
_SPACE = np.array([i for i in range(0x3001) if chr(i).isspace()], dtype=np.uint32)
_IS_SPACE = np.zeros(0x3001, dtype=bool)
_IS_SPACE[_SPACE] = True


def gram_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct pieces of every text, as sorted integers; none for null or under three characters.

    White space is removed first. Three code points fit into 63 bits, so no hash is involved.
    """
    found = []
    for t in texts:
        c = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = c[~_IS_SPACE[np.minimum(c, 0x3000)] | (c > 0x3000)].astype(np.int64)
        g = c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) >= GRAM else c[:0]
        found.append(np.unique(g))
    return found


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets as :func:`gram_sets` gives them; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = x * by
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Segments (n, SEGMENTS) as 23-bit words and anchors (n, SEGMENTS) of non-empty sets."""
    n, bits = len(sets), golay.BITS
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    g = np.concatenate(sets).astype(np.uint64)
    base = np.repeat(np.arange(n, dtype=np.int64) * bits, size)
    words = np.zeros((n, SEGMENTS), dtype=np.int64)
    anchors = np.zeros((n, SEGMENTS), dtype=np.uint64)
    weight = 1 << np.arange(bits, dtype=np.int64)
    for i in range(SEGMENTS):
        h = _mix(g, _MUL[i, 0])
        place = base + ((h >> np.uint64(40)) * np.uint64(bits) >> np.uint64(24)).astype(np.int64)
        least = np.full(n * bits, 0xFFFFFFFE, dtype=np.uint32)
        np.minimum.at(least, place, h.astype(np.uint32))
        words[:, i] = ((least & 1).reshape(n, bits) * weight).sum(1)
        a = np.minimum.reduceat(h * _MUL[i, 1] ^ (h >> np.uint64(31)), starts)
        b = np.minimum.reduceat(h * _MUL[i, 2] ^ (h >> np.uint64(33)), starts)
        anchors[:, i] = _mix(a ^ _mix(b, _MUL[i, 3]), _MUL[i, 1])
    return words, anchors


def _sketches(words: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Four longs: three of 64 bits of the fingerprint, and 48 bits above the size."""
    segments = -(-SKETCH_BITS // golay.BITS)
    bits = ((words[:, :segments, None] >> np.arange(golay.BITS)) & 1).reshape(len(words), -1)[:, :SKETCH_BITS].astype(np.uint64)
    shift = np.arange(64, dtype=np.uint64)
    whole = [(bits[:, i : i + 64] << shift).sum(1, dtype=np.uint64) for i in range(0, 192, 64)]
    last = (bits[:, 192:] << shift[16:]).sum(1, dtype=np.uint64) | np.minimum(size, SIZE_MOST).astype(np.uint64)
    return [x.view(np.int64) for x in (*whole, last)]


def _slices(lengths: np.ndarray) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > SLICE:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("body").to_pylist()
        scopes = batch.column("scope_hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for part in _slices(np.array([len(t or "") for t in texts])):
            sets = gram_sets(texts[part])
            keep = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
            if not len(keep):
                continue
            sets = [sets[i] for i in keep]
            scope = scopes[part][keep]
            words, anchors = fingerprints(sets)
            index, used = golay.codeword_keys(words)
            keys = _mix(anchors[:, :, None] ^ (index.astype(np.uint64) << np.uint64(8) | np.arange(SEGMENTS, dtype=np.uint64)[None, :, None]), _MUL[0, 0])
            keys = _mix(keys ^ scope[:, None, None], _MUL[1, 0]).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(used.sum((1, 2)))]).astype(np.int32)
            tid = batch.column("tid").slice(part.start, part.stop - part.start).take(pa.array(keep))
            sketch = _sketches(words, np.array([len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays(
                [tid, *map(pa.array, sketch), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[used]))],
                names=["tid", *_LONGS, "keys"],
            )


def candidate_pairs(signed: DataFrame) -> DataFrame:
    """Pairs of texts (tid_a < tid_b) that share a key and pass size and sketch, each once."""
    keys = signed.select(F.explode("keys").alias("key"), "tid", *_LONGS)
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("tid", *_LONGS))) for x in "ab")
    size_a, size_b = (F.col(f"s4_{x}").bitwiseAND(SIZE_MOST) for x in "ab")

    def apart(c: str) -> Column:
        return F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))

    return (
        a.join(b, "key")
        .where(F.col("tid_a") < F.col("tid_b"))
        .where(F.bit_count(apart("s1")) + F.bit_count(apart("s2")) + F.bit_count(apart("s3")) + F.bit_count(F.shiftrightunsigned(apart("s4"), 16)) <= SKETCH_MOST)
        .where((F.least(size_a, size_b) >= THRESHOLD * F.greatest(size_a, size_b)) | (F.greatest(size_a, size_b) == SIZE_MOST))
        .select("tid_a", "tid_b")
        .distinct()
    )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (gram_sets(batch.column(c).to_pylist()) for c in ("text_a", "text_b"))
        keep = [i for i, (x, y) in enumerate(zip(a, b)) if similarity(x, y) >= THRESHOLD - 1e-12]
        yield batch.select(["tid_a", "tid_b"]).take(pa.array(keep, type=pa.int64()))


def _named(items: DataFrame) -> DataFrame:
    """Rows that can have a partner, with two hashes (128 bits) and the length of body, kind and scope."""
    whole = ("kind", "scope", "body")
    return (
        items.select("kind", "scope", "item_id", "body")
        .where("body is not null and length(body) >= 3 and scope is not null")
        .withColumns({"h1": F.xxhash64(*whole), "h2": F.xxhash64(F.length("body"), F.reverse("body"), "kind", "scope")})
    )


def similar_texts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate texts of a table (kind, scope, item_id, body).

    Rows are compared within one kind and scope. Returns (members, pairs): members has
    every comparable row, repeated ones too, as (tid, kind, item_id), where tid names its distinct body within kind and scope;
    pairs has (tid_a, tid_b), tid_a < tid_b, with similarity at least 0.7, each once. Rows with a null body, a body
    under three characters or a null scope are similar to none. A repeated row changes nothing; other
    columns are ignored.
    """
    rows = _named(items)
    texts = materialize(
        rows.select("h1", "h2", "kind", "scope", "body").distinct().withColumn("tid", F.monotonically_increasing_id()), "texts"
    )
    signed = texts.select("tid", "body", F.xxhash64("kind", "scope").alias("scope_hash")).mapInArrow(
        _sign, "tid long, s1 long, s2 long, s3 long, s4 long, keys array<long>"
    )
    found = materialize(candidate_pairs(signed), "near")
    bodies = texts.select("tid", "body")
    pairs = (
        found.join(bodies.toDF("tid_a", "text_a"), "tid_a")
        .join(bodies.toDF("tid_b", "text_b"), "tid_b")
        .mapInArrow(_verify, "tid_a long, tid_b long")
    )
    members = rows.select("h1", "h2", "kind", "item_id").join(texts.select("h1", "h2", "tid"), ["h1", "h2"])
    return members.select("tid", "kind", "item_id"), pairs


def similar_rows(items: DataFrame) -> DataFrame:
    """All pairs of rows (kind, id_a, id_b), smaller id first, whose texts are near-duplicates or equal."""
    members, pairs = similar_texts(items)
    members, pairs = materialize(members, "members"), materialize(pairs, "pairs")
    a, b = (members.toDF(f"tid_{x}", kind, f"id_{x}") for x, kind in (("a", "kind"), ("b", "kind_b")))
    near = pairs.join(a, "tid_a").join(b, "tid_b")
    same = a.join(b, F.col("tid_a") == F.col("tid_b")).where(F.col("id_a") < F.col("id_b"))
    return (
        near.select("kind", "id_a", "id_b")
        .unionAll(same.select("kind", "id_a", "id_b"))
        .select("kind", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        .where(F.col("id_a") != F.col("id_b"))
        .distinct()
    )


def grouped_rows(items: DataFrame) -> DataFrame:
    """One row per comparable row: kind, item_id, group (an id of a text), links (near texts of its text, copies aside), copies (rows with the same text, itself included)."""
    from docmill.llm.groups import connected

    members, pairs = similar_texts(items)
    members, pairs = materialize(members.distinct(), "members"), materialize(pairs, "pairs")
    groups = connected(members, pairs)
    links = pairs.select(F.explode(F.array("tid_a", "tid_b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("links"))
    copies = members.groupBy("tid").agg(F.count("*").alias("copies"))
    return members.join(groups, "tid").join(copies, "tid").join(links, "tid", "left").select("kind", "item_id", "group", F.coalesce("links", F.lit(0)).alias("links"), "copies")
