"""Near-duplicates by set similarity with SetSketch registers.

A document's set of shingles becomes REGISTERS registers. A register is the least of the set's hashes under one
function, as an exponential variable of rate RATE, of which only the exponent to the base BASE is kept, truncated to
16 bits: registers are mergeable (the larger one wins) and two sets agree in a register about as often as their
Jaccard similarity. Registers of BAND in a row are banded; sets that share a band are candidates, whose similarity is
estimated by maximum likelihood from the registers that are larger, smaller and equal, and from both set sizes.
Candidates that the likelihood doesn't rule out are verified on their full sets.

So that a group of many near copies doesn't cost a pair of each two, every set is first held against one hub for each
of its bands, and pairs are then sought only between parts that are still apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import SOLID, broadcast_up_to, discard, stored, words
from docketry.llm.components import components

#: Registers of a sketch; base and rate of their scale; registers in a band. At similarity 0.8 all 32 bands differ with probability (1 - 0.8^4)^32 < 5e-8.
REGISTERS, BASE, RATE, BAND = 128, 1.001, 20.0, 4
SHINGLE, SIMILAR = 5, 80
#: Standard deviations below the threshold from which an estimate rules a pair out.
SIGMAS = 6.0
#: Hashes sketched at once, bytes of keys that are broadcast, and sketches and hashes of either side of a cell of pairs, about.
CHUNK, BROADCAST, CELL_ROWS, CELL_HASHES = 1 << 15, 64 << 20, 1 << 14, 1 << 21


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the registers' hash functions, fixed by a seed."""
    rnd = np.random.Generator(np.random.PCG64(42))
    return rnd.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(0, 1 << 63, REGISTERS, np.uint64)


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers, one row for each list of hashes [offsets[i], offsets[i + 1]), none of which is empty."""
    factors, summands = _functions()
    least = np.empty((len(offsets) - 1, REGISTERS), np.uint64)
    at = 0
    while at < len(least):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        part, cuts = hashes[offsets[at] : offsets[end]], offsets[at:end] - offsets[at]
        for i in range(REGISTERS):
            least[at:end, i] = np.minimum.reduceat(part * factors[i] + summands[i], cuts)
        at = end
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(variate) / math.log(BASE)), 0, 65535).astype("<u2")


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(one, other)


def _larger(x: np.ndarray) -> np.ndarray:
    """Probability that a register is strictly larger on the side that alone holds the share x of the union's rate."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(j: np.ndarray, larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Of similarity j, given the number of registers that are larger and smaller in a than in b, and both set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    up, down = _larger(np.maximum(u - v * j, 0)), _larger(np.maximum(v - u * j, 0))
    tiny = 1e-300
    return larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + (REGISTERS - larger - smaller) * np.log(np.maximum(1 - up - down, tiny))


def estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of largest likelihood, by golden section: the likelihood is concave."""
    low, high = np.zeros(len(n_a)), np.minimum(n_a / n_b, n_b / n_a)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(25):
        one, two = high - golden * (high - low), low + golden * (high - low)
        left = log_likelihood(one, larger, smaller, n_a, n_b) > log_likelihood(two, larger, smaller, n_a, n_b)
        low, high = np.where(left, low, one), np.where(left, two, high)
    return (low + high) / 2


def may_be(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similar: int) -> np.ndarray:
    """Whether the likelihood doesn't rule the similarity in percent out.

    Where it still rises towards that similarity the estimate reaches it; only where it falls the estimate is sought.
    """
    of = lambda j, at: log_likelihood(j, larger[at], smaller[at], n_a[at], n_b[at])
    every = np.arange(len(n_a))
    asked = np.minimum(similar / 100, np.minimum(n_a / n_b, n_b / n_a))
    there = of(asked, every)
    out = there >= of(asked - 1e-6, every)
    falls = np.flatnonzero(~out)
    if len(falls):
        best = of(estimate(larger[falls], smaller[falls], n_a[falls], n_b[falls]), falls)
        out[falls] = 2 * (best - there[falls]) <= SIGMAS**2
    return out


def shingled(text: Column, n: int) -> Column:
    """Struct of a 16-byte digest of the words (null without any) and the hashes of their n-word shingles, repeats included."""

    def of(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + F.lit(k)) for k in range(n)])))
        hashes = F.when(F.size(w) >= n, every).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.when(F.size(w) > 0, F.unhex(F.md5(F.array_join(w, " ")))).alias("digest"), hashes.alias("hashes"))

    return F.element_at(F.transform(F.array(words(text, SOLID)), of), 1)


def sketched(docs: DataFrame, text: str = "text", row_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id, digest, n, sketch, even, odd): digest of the words, set size, registers as bytes, and their parities in two longs. Wordless: n = 0, else null."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = [len(np.unique(flat[a:b])) for a, b in zip(offsets, offsets[1:], strict=False)]
            full = np.flatnonzero(np.diff(offsets))
            cuts = np.append(offsets[full], offsets[-1]).astype(np.int64)
            found = registers(flat, cuts) if len(full) else np.zeros((0, REGISTERS), "<u2")
            bits = np.packbits((found & 1).astype(np.uint8), axis=1).view("<i8")
            at = np.full(len(sizes), -1)
            at[full] = np.arange(len(full))
            pick = pa.array(np.where(at < 0, None, at), pa.int64())
            more = [pa.array([x.tobytes() for x in found], pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), *[x.take(pick) for x in more]], names=["id", "digest", "n", "sketch", "even", "odd"])

    rows = docs.select(F.col(row_id).cast("long").alias("id"), shingled(F.col(text), shingle).alias("s")).select("id", "s.digest", "s.hashes")
    return rows.mapInArrow(sketch, "id bigint, digest binary, n int, sketch binary, even bigint, odd bigint")


def band_keys() -> Column:
    """A key for each band of `sketch`."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * BAND * 2 + 1, BAND * 2)) for i in range(REGISTERS // BAND)])


def most_apart(share: float) -> int:
    """Registers that may differ where each does with the probability: beyond, chance is about that of 7 standard deviations."""
    return min(REGISTERS, math.ceil(REGISTERS * share + 7 * math.sqrt(REGISTERS * share * (1 - share)) + 2))


def may_reach(similar: int) -> Column:
    """Sizes and parities don't rule out that rows a and b reach the similarity. Registers that differ have different parities half the time."""
    apart = F.bit_count(F.col("a.even").bitwiseXOR(F.col("b.even"))) + F.bit_count(F.col("a.odd").bitwiseXOR(F.col("b.odd")))
    return (F.least("a.n", "b.n").cast("long") * 100 >= F.greatest("a.n", "b.n").cast("long") * similar) & (apart <= most_apart((1 - similar / 100) / 2))


def likely(pairs: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """Those pairs (a, b) whose similarity the registers don't rule out, with their estimate."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy().astype(np.float64) for i in (4, 5))
            larger, smaller = (one > two).sum(1), (one < two).sum(1)
            keep, j = pa.array(may_be(larger, smaller, n_a, n_b, similar)), estimate(larger, smaller, n_a, n_b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j)], names=["a", "b", "j"]).filter(keep)

    side = lambda c: nodes.select(F.col("nid").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(judge, "a bigint, b bigint, j double")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, text: str, row_id: str, shingle: int) -> DataFrame:
    """(nid, set) of the wanted nodes, computed again from the text of one row of each: rows are met by id, or by digest without one."""
    keys = stored(nodes.join(wanted.distinct(), "nid").select("nid", "digest", F.col("least.id").alias("_id")))
    size = keys.count() * 48
    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    digest = F.unhex(F.md5(F.array_join(words(F.col("text"), SOLID), " ")))
    named = rows.join(broadcast_up_to(keys.where("_id is not null"), size, BROADCAST), F.col("id") == F.col("_id")).where(digest == F.col("digest"))
    unnamed = rows.where("id is null").join(broadcast_up_to(keys.where("_id is null"), size, BROADCAST), digest == F.col("digest"))
    rows = named.select("nid", "text").unionByName(unnamed.select("nid", "text")).dropDuplicates(["nid"])
    return stored(rows.select("nid", F.array_sort(F.array_distinct(shingled(F.col("text"), shingle)["hashes"])).alias("set")))


def verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have the similarity in percent."""
    both = pairs.select("a", "b").join(sets.select(F.col("nid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("nid").alias("b"), F.col("set").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y")).cast("long")
    return both.withColumn("_same", same).where(F.col("_same") * 100 >= (F.size("x") + F.size("y") - F.col("_same")) * similar).select("a", "b")


def hub_pairs(members: DataFrame, nodes: DataFrame, similar: int) -> DataFrame:
    """Each node with the hubs of its bands, of which the likeliest of either kind stays: at most two for a node."""
    side = lambda c: nodes.select("nid", "n", "even", "odd").alias(c)
    hubs = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("one").alias("hub")), F.struct(F.lit(1).alias("kind"), F.col("two").alias("hub"))))
    pairs = stored(members.select("nid", hubs.alias("h")).select("nid", "h.*").where("nid <> hub").groupBy("nid", "hub").agg(F.min("kind").alias("kind")))
    near = pairs.alias("p").join(side("a"), F.col("p.nid") == F.col("a.nid")).join(side("b"), F.col("p.hub") == F.col("b.nid")).where(may_reach(similar))
    best = likely(near.select(F.col("p.nid").alias("a"), F.col("p.hub").alias("b")), nodes, similar)
    best = best.join(pairs.select(F.col("nid").alias("a"), F.col("hub").alias("b"), "kind"), ["a", "b"])
    return best.groupBy("a", "kind").agg(F.max(F.struct("j", "b")).alias("top")).select("a", F.col("top.b").alias("b"))


def cells(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows (key, minor, nid, ...) of each band dealt out so that a cell holds about `most` of `size` at most.

    A cell joins some of a band's minor rows (side 1) with some of all its rows (side 2); both are 3 where one cell
    holds the band. Every minor row meets every row of its band in one cell.
    """
    totals = rows.groupBy("key").agg(F.sum(F.when(F.col("minor"), size).otherwise(0)).alias("minors"), F.sum(size).alias("all"))
    number = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    dealt = rows.join(totals.select("key", number("minors").alias("_ones"), number("all").alias("_twos")), "key")
    one, two = F.pmod(F.xxhash64("nid"), F.col("_ones")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "nid"), F.col("_twos")).cast("int")
    cell = lambda x, y, side: F.struct(x.alias("one"), y.alias("two"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<one: int, two: int, side: int>>")
    asking = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0), F.col("_twos") - 1), lambda y: cell(one, y, 1))).otherwise(none)
    asked = F.transform(F.sequence(F.lit(0), F.col("_ones") - 1), lambda x: cell(x, two, 2))
    alone = (F.col("_ones") == 1) & (F.col("_twos") == 1)
    every = F.when(alone, F.array(cell(F.lit(0), F.lit(0), 3))).otherwise(F.concat(asking, asked))
    return dealt.withColumn("_cell", F.explode(every)).select(*rows.columns, "_cell.*")


def by_cell(rows: DataFrame, judge, schema: str) -> DataFrame:
    """What `judge(cell)` yields for each cell, a table of its rows, as the sorted cells stream by."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(table: pa.Table) -> Iterator[pa.RecordBatch]:
            found = judge(table.combine_chunks())
            if found is not None and found.num_rows:
                yield found

        last = None
        for batch in batches:
            key, one, two = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "one", "two"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            at = 0
            for cut in [*cuts.tolist(), batch.num_rows]:
                now = (key[at], one[at], two[at]) if at < batch.num_rows else last
                if held and now != last:
                    yield from ready(pa.Table.from_batches(held))
                    held = []
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                last, at = now, cut
        if held:
            yield from ready(pa.Table.from_batches(held))

    return rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(stream, schema)


def likely_here(cell: pa.Table, similar: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each minor row of a cell its place there, and those of the rows it may link with: of another root, of likely
    similarity, and of no earlier band in common, so that a pair is met in one band only."""
    column = lambda c: cell.column(c).to_numpy()
    nid, root, n, side, minor, band = column("nid"), column("root"), column("n").astype(np.float64), column("side"), cell.column("minor").to_numpy(), int(cell.column("band")[0].as_py())
    sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), "<u2").reshape(-1, REGISTERS)
    asked = np.flatnonzero(side & 2)
    for x in np.flatnonzero((side & 1).astype(bool) & minor).tolist():
        fits = (root[asked] != root[x]) & (np.minimum(n[asked], n[x]) * 100 >= np.maximum(n[asked], n[x]) * similar)
        fits &= ~minor[asked] | (nid[asked] < nid[x])
        y = asked[fits]
        if band:
            y = y[~(sketch[y][:, : band * BAND] == sketch[x, : band * BAND]).reshape(len(y), band, BAND).all(2).any(1)]
        if len(y):
            y = y[(sketch[x] != sketch[y]).sum(1) <= most_apart(1 - similar / 100)]
        if len(y):
            larger, smaller = (sketch[x] > sketch[y]).sum(1), (sketch[x] < sketch[y]).sum(1)
            y = y[may_be(larger, smaller, np.full(len(y), n[x]), n[y], similar)]
        if len(y):
            yield x, y, root[y]


def cross_links(docs: DataFrame, members: DataFrame, nodes: DataFrame, similar: int, text: str, row_id: str, shingle: int) -> DataFrame:
    """Links (a, b) between roots of nodes that share a band, have different roots and the similarity.

    The nodes of a band's commonest root are met by the others only, never by each other, and pairs are looked at
    where they meet: only nodes that may have a link fetch their full sets, and only links leave a cell.
    """
    told = members.select("key", "band", "nid").join(nodes.select("nid", "root", "n"), "nid")
    shares = told.groupBy("key", "root").agg(F.count(F.lit(1)).alias("often"))
    major = shares.groupBy("key").agg(F.max(F.struct("often", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", F.col("top.root").alias("major"))
    told = stored(told.join(major, "key").withColumn("minor", F.col("root") != F.col("major")).drop("major"))

    def wanted(cell: pa.Table) -> pa.RecordBatch | None:
        seen = np.zeros(cell.num_rows, bool)
        for x, y, _ in likely_here(cell, similar):
            seen[x] = True
            seen[y] = True
        rows = cell.select(["key", "nid"]).take(np.flatnonzero(seen))
        return rows.combine_chunks().to_batches()[0] if rows.num_rows else None

    with_sketch = told.join(nodes.select("nid", "sketch"), "nid")
    hits = stored(by_cell(cells(with_sketch, F.lit(1), CELL_ROWS), wanted, "key bigint, nid bigint").distinct())
    sets = full_sets(docs, nodes, hits.select("nid"), text, row_id, shingle)

    def linked(cell: pa.Table) -> pa.RecordBatch | None:
        lists = cell.column("set").combine_chunks() if cell.column("set").num_chunks != 1 else cell.column("set").chunk(0)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        roots, top = cell.column("root").to_numpy(), {}

        def find(r: int) -> int:
            while top.get(r, r) != r:
                r = top[r]
            return r

        out = []
        for x, y, _ in likely_here(cell, similar):
            own = flat[offsets[x] : offsets[x + 1]]
            for z in y.tolist():
                a, b = find(int(roots[x])), find(int(roots[z]))
                if a == b:
                    continue
                other = flat[offsets[z] : offsets[z + 1]]
                at = np.searchsorted(own, other)
                same = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                if same * 100 >= (len(own) + len(other) - same) * similar:
                    top[max(a, b)] = min(a, b)
                    out.append((int(roots[x]), int(roots[z])))
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"]) if out else None

    full = told.join(hits, ["key", "nid"]).join(nodes.select("nid", "sketch"), "nid").join(sets, "nid")
    return by_cell(cells(full, F.col("n"), CELL_HASHES), linked, "a bigint, b bigint")


def near_sets(docs: DataFrame, text: str = "text", row_id: str = "doc_id", shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    Texts in lower case (A-Z) are cut at ASCII white space; shingles are runs of `shingle` words, or all words where
    there are fewer. Documents link where 100 * intersection >= similar * union; component_id is the smallest id that
    links reach, itself included, null ids last, and the row that has it is kept. Texts that are null or without words
    have 0 shingles and link with nothing, not even each other. Texts of the same words are one node, so copies and
    rows that repeat cost no pairs and share a component; rows that repeat an id are documents of their own, and where
    the smallest is repeated all its rows are kept. Without any id a component's is null and all its rows are kept.
    Columns beyond these two aren't read. Empty in, empty out. Links are confirmed on full sets of 64-bit hashes; a
    link at the threshold itself is missed with a probability below 1e-7.
    """
    rows = stored(sketched(docs, text, row_id, shingle))
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id")).alias("least")
    nodes = rows.where("n > 0").groupBy("digest").agg(least, F.first(F.struct("n", "sketch", "even", "odd")).alias("s"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("nid"), "digest", "least", "s.*"))

    every = nodes.select("nid", F.posexplode(band_keys()).alias("band", "key"))
    place = F.struct(F.xxhash64("nid").alias("h"), "nid")
    hubs = every.groupBy("key").agg(F.min(place).alias("one"), F.max(place).alias("two")).where("one.nid <> two.nid")
    members = stored(every.join(hubs.select("key", F.col("one.nid").alias("one"), F.col("two.nid").alias("two")), "key"))

    pairs = stored(hub_pairs(members, nodes, similar))
    sets = full_sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("nid")), text, row_id, shingle)
    links = components(verified(pairs, sets, similar))
    now = stored(nodes.join(links.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid")))

    links = components(cross_links(docs, members, now, similar, text, row_id, shingle)).select(F.col("node").alias("root"), F.col("root").alias("last"))
    final = now.join(links, "root", "left").select("digest", "least", F.coalesce("last", "root").alias("root"))
    first = final.groupBy("root").agg(F.min("least").alias("first"))
    by_digest = stored(final.join(first, "root").select("digest", F.col("first.id").alias("component_id")))
    discard(members, pairs, sets, now)

    named = rows.select("id", "digest", "n").where("n > 0").join(by_digest, "digest").select("id", "n", "component_id")
    out = named.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
