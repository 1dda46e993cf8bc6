"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints that differ in at most `radius` bits differ in at
most radius / segments bits of some segment, so each fingerprint looks up, for every segment, all values in the
Hamming ball of that radius in the table of the segments' values; what it fetches is verified by complete distance.
Links join distinct fingerprints, so copies are one node; components come from the links. So that a cluster of many
near fingerprints doesn't cost a pair of each two, stars join most of it first, and pairs are then sought only
between parts that are still apart.

All tables here grow with the rows, and Spark sizes them too low, so every join is of two sorted shuffles, whatever
Spark would broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import SOLID, merged, stored, words
from docketry.llm.components import components

BITS, RADIUS, SHINGLE = 64, 4, 4
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of the n-word shingles, space-joined, repeats included; of fewer words, of the whole sequence."""
    ws = words(text, SOLID)

    def of(w: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + F.lit(k)) for k in range(n)])))
        return F.when(F.size(w) >= n, shingles).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    # The words are computed once: as the only element of an array that a lambda takes.
    return F.element_at(F.transform(F.array(ws), of), 1)


def majority_bits(hashes: pa.Array) -> pa.Array:
    """For each list of hashes the bits set in over half of them; 0 for an empty list."""
    offsets = hashes.offsets.to_numpy().astype(np.int64)
    flat = hashes.values.to_numpy(zero_copy_only=False).astype("<i8", copy=False)
    rows = len(hashes)
    counts = np.zeros((rows, BITS), np.int64)
    for at in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        end = min(at + CHUNK, int(offsets[-1]))
        bits = np.unpackbits(flat[at:end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")
        full = np.arange(first, last)
        full = full[offsets[full + 1] > offsets[full]]
        counts[full] += np.add.reduceat(bits, np.maximum(offsets[full], at) - at, axis=0, dtype=np.int64)
    over = counts * 2 > np.diff(offsets)[:, None]
    packed = np.packbits(over, axis=1, bitorder="little").view("<i8").reshape(-1) if rows else np.zeros(0, np.int64)
    return pa.array(packed, pa.int64())


def fingerprints(docs: DataFrame, text: str = "text", row_id: str = "doc_id", digest: Column | None = None) -> DataFrame:
    """(id, fingerprint as a signed long) of every row, and its `digest`, a long, if one is given. Null or wordless text: 0."""

    def majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), majority_bits(batch.column(1)), *batch.columns[2:]], names=["id", "fingerprint", *batch.schema.names[2:]])

    more = [] if digest is None else [digest.alias("digest")]
    return docs.select(F.col(row_id).cast("long").alias("id"), shingle_hashes(F.col(text)).alias("hashes"), *more).mapInArrow(majority, "id bigint, fingerprint bigint" + ", digest bigint" * len(more))


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each segment, sizes at most one apart."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


#: Distinct fingerprints beyond which two long segments fetch less by chance than three short ones.
MANY = 1 << 25


def parts(segments: int) -> list[Column]:
    """The segments of `fingerprint`, each with its number above it."""
    return [F.shiftrightunsigned(F.col("fingerprint"), first).bitwiseAND(F.lit((1 << size) - 1)).bitwiseOR(F.lit(j << 48)) for j, (first, size) in enumerate(segment_bounds(segments))]


def near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def star_links(marks: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of fingerprints that agree in all but one of three segments to the least that does, where it is near.

    They are at most three for each fingerprint, and join most of a cluster before any pair is sought in it.
    """
    cut = parts(3)
    every = marks.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), *[p.alias(f"p{i}") for i, p in enumerate(c for k, c in enumerate(cut) if k != j)]) for j in range(3)])).alias("key"))
    least = stored(every.groupBy("key").agg(F.min("fingerprint").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b"))
    return every.join(merged(least), "key").where((F.col("fingerprint") != F.col("b")) & near("fingerprint", "b", radius)).select(F.col("fingerprint").alias("a"), "b")


def near_pairs(marks: DataFrame, radius: int = RADIUS, many: int = MANY) -> DataFrame:
    """Pairs (a, b, ra, rb), a below b, of distinct fingerprints that differ in 1 to `radius` bits, and their different roots.

    `marks` is (fingerprint, root); without a root every pair counts. Each fingerprint visits, for every segment, the
    values in the ball of its own. The members of a value that share its commonest root are only met by visitors of
    other roots, so that a cluster that is joined already meets itself nowhere; all others are met by every visitor.
    """
    root = F.col("root") if "root" in marks.columns else F.col("fingerprint")
    marks = marks.select("fingerprint", root.alias("root"))
    segments = 3 if marks.count() <= many else 2
    probes = []
    for part, (_, size) in zip(parts(segments), segment_bounds(segments), strict=True):
        for r in range(radius // segments + 1):
            probes += [part.bitwiseXOR(F.lit(sum(1 << i for i in flipped))) for flipped in combinations(range(size), r)]
    visits = marks.select(F.col("fingerprint").alias("a"), F.col("root").alias("ra"), F.explode(F.array(*probes)).alias("key"))
    own = stored(marks.select(F.col("fingerprint").alias("b"), F.col("root").alias("rb"), F.explode(F.array(*parts(segments))).alias("key")))
    shares = own.groupBy("key", "rb").agg(F.count(F.lit(1)).alias("n"))
    # Values with several members of one root: their commonest root is the major one.
    major = stored(shares.groupBy("key").agg(F.max(F.struct("n", "rb")).alias("top")).where("top.n > 1").select("key", F.col("top.rb").alias("major")))
    told = own.join(merged(major), "key", "left")
    met = near("a", "b", radius) & (F.col("a") != F.col("b")) & (F.col("ra") != F.col("rb"))
    other = visits.join(merged(told.where(F.col("major").isNull() | (F.col("rb") != F.col("major"))).select("key", "b", "rb")), "key").where(met)
    strange = visits.join(merged(major), "key").where(F.col("ra") != F.col("major")).select("key", "a", "ra")
    same = strange.join(merged(told.where(F.col("rb") == F.col("major")).select("key", "b", "rb")), "key").where(met)
    found = other.select("a", "b", "ra", "rb").unionByName(same.select("a", "b", "ra", "rb"))
    pair = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "ra", "rb")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rb").alias("ra"), F.col("ra").alias("rb")))
    return found.select(pair.alias("p")).select("p.*").distinct()


def rooted(nodes: DataFrame, radius: int = RADIUS, many: int = MANY) -> DataFrame:
    """(fingerprint, first, root) from (fingerprint, first) of distinct fingerprints: root is the least `first` of the component.

    `first` is an ordered struct with the fingerprint in it. Stars come first; then whatever they left apart is sought,
    and only the roots of such pairs are joined further.
    """

    def linked(of: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
        """(node, root) of the `first`s whose fingerprints the links join."""
        end = lambda c, name: merged(of.select(F.col("fingerprint").alias(c), F.col("first").alias(name)))
        return components(links.select(a, b).distinct().join(end(a, "_a"), a).join(end(b, "_b"), b).select(F.col("_a").alias("a"), F.col("_b").alias("b")))

    by_star = linked(nodes, star_links(nodes, radius), "a", "b")
    by_star = stored(nodes.join(merged(by_star), nodes["first"] == by_star["node"], "left").select("fingerprint", "first", F.coalesce("root", "first").alias("root")))
    pairs = stored(near_pairs(by_star.select("fingerprint", F.col("root.fingerprint").alias("root")), radius, many))
    if pairs.isEmpty():
        return by_star
    joined = linked(by_star.where("first = root"), pairs, "ra", "rb").select("node", F.col("root").alias("least"))
    return stored(by_star.join(merged(joined), by_star["root"] == joined["node"], "left").select("fingerprint", "first", F.coalesce("least", "root").alias("root")))


def one_of_each(docs: DataFrame, digest: Column, radius: int = RADIUS) -> DataFrame:
    """(doc_id, digest, times) of one row of each component: that of the least id, null ids last, and of its least digest.

    `times` rows have that id and digest. Rows of one digest must have one text.
    """
    marks = stored(fingerprints(docs, digest=digest))
    rows = marks.groupBy("fingerprint", "id", "digest").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest", "times", "fingerprint")).alias("first")
    kept = rooted(stored(rows.groupBy("fingerprint").agg(first)), radius).where("first = root")
    return kept.select(F.col("first.id").alias("doc_id"), "first.digest", "first.times")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, many: int = MANY) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    component_id is the smallest doc_id that links reach, itself included; rows without words have fingerprint zero
    and link like any other. Null ids never are a component's id unless all its ids are null. Rows that repeat share
    a component. Columns beyond doc_id and text aren't read. Empty in, empty out.
    """
    marks = stored(fingerprints(docs))
    nodes = marks.groupBy("fingerprint").agg(F.min("id").alias("least"))
    nodes = stored(nodes.select("fingerprint", F.struct(F.col("least").isNull().alias("unnamed"), "least", "fingerprint").alias("first")))
    by_mark = rooted(nodes, radius, many).select("fingerprint", F.col("root.least").alias("component_id"))
    return marks.join(merged(by_mark), "fingerprint").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
