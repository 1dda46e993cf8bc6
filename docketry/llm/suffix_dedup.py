"""Removal of byte strings that stand anywhere else, by suffix sorting in shards.

Whether a string of SPAN bytes repeats is a matter of the suffixes that begin with it. To sort them in shards that
never need each other, every start is given an anchor: the least hash of the GRAM-byte strings within its SPAN bytes.
Equal strings have equal anchors, so a shard that holds all starts of some anchors holds all copies of their
strings. Anchors seen once need no sorting. The starts of an anchor that follow one another in a document travel as
one context, the bytes that their strings cover. A shard sorts the suffixes of its distinct contexts by external
induction (see `suffix`); starts whose common prefix with a neighbour reaches SPAN, or whose context comes twice,
repeat. Where an anchor has more contexts than HOT, a second anchor, the least hash but for the first, splits each into
smaller ones, and equal ones are counted first, so that one of each is sorted. What is sorted together may be larger
than memory. Equal texts are one text with a count.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import stored
from docketry.llm.suffix import Scratch, suffix_chunks

SPAN, GRAM = 200, 32
#: Contexts of one anchor beyond which a second anchor splits them.
HOT = 20_000
#: Bytes of contexts that are sorted together at least, where a partition has as many; anchors aren't parted.
PART_BYTES = 2 << 20
#: Odd multipliers of the gram hash.
MIX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x9E3779B97F4A7C15)


def extremes(x: np.ndarray, width: int, of: np.ufunc, filler: int) -> np.ndarray:
    """The least or largest of each `width` neighbours: of what is left of a block's end and what is right of it."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, filler, np.uint64)]).reshape(-1, width)
    upto, onward = of.accumulate(blocks, 1).reshape(-1), of.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return of(onward[:n], upto[width - 1 : width - 1 + n])


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte strings at each place."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 8)).view("<u8").reshape(-1)
    m = len(b) - GRAM + 1
    h = words[:m] * np.uint64(MIX[0])
    for k in range(1, GRAM // 8):
        h ^= h >> np.uint64(29)
        h += words[8 * k : 8 * k + m]
        h *= np.uint64(MIX[k])
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX[4])
    h ^= h >> np.uint64(29)
    return h


TOP = np.iinfo(np.uint64).max


def anchors(raw: bytes, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, number of starts, whether it comes twice) of each run of starts with one anchor.

    A run may hold equal strings only if the anchor stands twice near each other. Below `span` bytes there is no run.
    """
    if len(raw) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    width = span - GRAM + 1
    least = extremes(h, width, np.minimum, TOP)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    # A gram is the least of some neighbours if it equals the largest of the leasts of all neighbours that hold it.
    rim = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == extremes(np.concatenate([rim, least, rim]), width, np.maximum, 0))
    twice = h[at[1:]][(h[at[1:]] == h[at[:-1]]) & (np.diff(at) <= width)]
    return least[first].view(np.int64), first, np.diff(np.append(first, len(least))), np.isin(least[first], twice) if len(twice) else np.zeros(len(first), bool)


def second_anchors(context: bytes, anchor: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair of anchors as one hash, first start, number of starts) of the runs within the context of one anchor."""
    h = gram_hashes(np.frombuffer(context, np.uint8))
    own = np.array([anchor], np.int64).view(np.uint64)[0]
    least = extremes(np.where(h == own, TOP, h), span - GRAM + 1, np.minimum, TOP)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    pair = (least[first] ^ (own >> np.uint64(17))) * np.uint64(MIX[0])
    return pair.view(np.int64), first, np.diff(np.append(first, len(least)))


def repeated_starts(contexts: list[bytes], scratch: Scratch, span: int = SPAN) -> list[np.ndarray]:
    """For each distinct context, which of its starts have a string that another start of any context has."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = scratch.array(int(sizes.sum()), np.uint8)
    ends = np.cumsum(sizes)
    for c, end in zip(contexts, ends.tolist(), strict=True):
        text[end - len(c) : end] = np.frombuffer(c, np.uint8)
    valid, repeats = scratch.array(len(text), bool), scratch.array(len(text), bool)
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        valid[end - size : end - span + 1] = True
    last, low = -1, span  # the valid start before, and the least common prefix since
    for at, lcp in suffix_chunks(text, 256, span, scratch):
        k = np.flatnonzero(valid[at])
        if not len(k):
            low = min(low, int(lcp.min()))
            continue
        # Between valid neighbours the common prefix is the least over those that stand between.
        common = np.minimum.reduceat(lcp[: k[-1] + 1], np.append(0, k[:-1] + 1))
        common[0] = min(common[0], low) if last >= 0 else 0
        now = at[k]
        same = common >= span
        repeats[now[same]] = True
        repeats[np.append(last, now[:-1])[same]] = True
        last, low = int(now[-1]), int(min(span, lcp[k[-1] + 1 :].min(initial=span)))
    return [repeats[end - size : end - span + 1] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last positions of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[0::2], edges[1::2]


def sort_shard(rows: pd.DataFrame, span: int = SPAN) -> pd.DataFrame:
    """(doc, a, b): ranges of bytes to remove, from the contexts (doc, start, bytes) of one shard."""
    digest = [hashlib.blake2b(c, digest_size=16).digest() for c in rows["bytes"]]
    which, _ = pd.factorize(pd.Series(digest))
    first = np.flatnonzero(~pd.Series(digest).duplicated())
    times = np.bincount(which, minlength=len(first))
    contexts = rows["bytes"].to_numpy()
    with tempfile.TemporaryDirectory() as folder:
        flags = repeated_starts([contexts[i] for i in first], Scratch(folder), span)
    out_row, out_a, out_b = [], [], []
    for i, (w, start) in enumerate(zip(which.tolist(), rows["start"].tolist(), strict=True)):
        n = len(flags[w])
        a, b = (np.array([0]), np.array([n])) if times[w] > 1 else runs(flags[w])
        if len(a):
            out_row.append(np.full(len(a), i))
            out_a.append(a + start)
            out_b.append(b + start + span - 1)
    k = np.concatenate(out_row) if out_row else np.zeros(0, np.int64)
    return pd.DataFrame({"doc": rows["doc"].to_numpy()[k], "a": np.concatenate([np.zeros(0, np.int64), *out_a]), "b": np.concatenate([np.zeros(0, np.int64), *out_b])})


ROWS = "doc binary, a bigint, b bigint"
PARTS = ["anchor", "doc", "start", "bytes"]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(anchor, doc, start, twice) of every run of starts of every text (doc, text), and whether the anchor comes twice near it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [anchors(text.as_py().encode()) for text in batch.column(1)]
            sizes = [len(p[0]) for p in parts]
            each = pa.array(np.repeat(np.arange(len(parts)), sizes))
            joined = lambda i, kind: pa.array(np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)]))
            yield pa.RecordBatch.from_arrays([joined(0, np.int64), batch.column(0).take(each), joined(1, np.int64), joined(3, bool)], names=["anchor", "doc", "start", "twice"])

    return docs.mapInArrow(found, "anchor bigint, doc binary, start bigint, twice boolean")


def contexts_of(docs: DataFrame) -> DataFrame:
    """(anchor, doc, start, bytes) from (doc, text, picks), picks being the first starts of repeated anchors."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, picks in zip(batch["doc"], batch["text"], batch["picks"], strict=True):
                raw = text.encode()
                h, first, n, _ = anchors(raw)
                for i in np.flatnonzero(np.isin(first, picks)).tolist():
                    a = int(first[i])
                    out.append((int(h[i]), doc, a, raw[a : a + int(n[i]) + SPAN - 1]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=PARTS)
                    out = []
            yield pd.DataFrame(out, columns=PARTS)

    return docs.mapInPandas(cut, "anchor bigint, doc binary, start bigint, bytes binary")


def sorted_ranges(contexts: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Ranges from contexts dealt out by anchor: each partition is a shard, taken in parts that hold whole anchors."""

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            upto = np.append(0, np.cumsum(rows["bytes"].map(len).to_numpy(np.int64)))
            anchor = rows["anchor"].to_numpy()
            begins = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            at = 0
            while len(cut := begins[(begins > at) & (upto[begins] - upto[at] >= part_bytes)]):
                yield sort_shard(rows[at : cut[0]].reset_index(drop=True))
                at = int(cut[0])
            held = rows[at:].reset_index(drop=True)
        if held is not None and len(held):
            yield sort_shard(held)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").select(*PARTS).mapInPandas(shard, ROWS)


def split_ranges(contexts: DataFrame) -> DataFrame:
    """Ranges from contexts of hot anchors, split by second anchors. Equal ones are counted, and one of each is sorted."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for anchor, doc, start, raw in zip(batch["anchor"], batch["doc"], batch["start"], batch["bytes"], strict=True):
                for pair, first, n in zip(*(x.tolist() for x in second_anchors(raw, anchor)), strict=True):
                    part = raw[first : first + n + SPAN - 1]
                    out.append((pair, doc, start + first, part, hashlib.blake2b(part, digest_size=16).digest()))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=[*PARTS, "digest"])
                    out = []
            yield pd.DataFrame(out, columns=[*PARTS, "digest"])

    own = stored(contexts.mapInPandas(cut, "anchor bigint, doc binary, start bigint, bytes binary, digest binary"))
    counted = stored(own.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes")))
    copies = counted.where("n > 1").select("digest", F.lit(0).cast("long").alias("from"), F.octet_length("bytes").cast("long").alias("to"))
    # One of each stands for its digest.
    found = sorted_ranges(counted.select("anchor", F.col("digest").alias("doc"), F.lit(0).cast("long").alias("start"), "bytes"))
    found = found.join(counted.where("n = 1").select(F.col("digest").alias("doc")), "doc", "left_semi")
    ranges = stored(copies.unionByName(found.select(F.col("doc").alias("digest"), F.col("a").alias("from"), F.col("b").alias("to"))))
    every = own.select("doc", "start", "digest").join(ranges, "digest")
    return every.select("doc", (F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("to")).alias("b"))


def removed(docs: DataFrame) -> DataFrame:
    """(doc, n_removed, n_spans, kept_sha256, spans) from (doc, text, ranges): the ranges' union is cut out."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch["text"], batch["ranges"], strict=True):
                raw, spans = text.encode(), []
                for r in sorted((r["a"], r["b"]) for r in ranges):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append([*r])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"a": a, "b": b} for a, b in spans]))
            out = pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "spans"])
            out.insert(0, "doc", batch["doc"].to_numpy())
            yield out

    return docs.mapInPandas(cut, "doc binary, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<a:bigint,b:bigint>>")


def one_of_each(rows: DataFrame, some: DataFrame) -> DataFrame:
    """One row (doc, text) and the columns of `some` for each of its texts, a table (doc, keep, same, ...).

    The row of id `keep` stays. Texts are dealt out again only where `same` rows repeat that id as well.
    """
    named = some.withColumnRenamed("doc", "_doc")
    kept = rows.join(named, (F.col("doc") == F.col("_doc")) & F.col("id").eqNullSafe(F.col("keep"))).drop("_doc", "id", "keep")
    return kept.where("same = 1").unionByName(kept.where("same > 1").dropDuplicates(["doc"])).drop("same")


def repeated_spans(docs: DataFrame, text: str = "text", row_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), spans as byte ranges.

    Every byte under a string of SPAN bytes that also starts elsewhere goes; strings are judged on the input. Null
    text is empty. Equal texts, with one id or many or none, are counted and looked at once: all that two or more rows
    have goes, if it is SPAN bytes long. Null ids are kept as they are. Columns beyond id and text aren't read. Empty
    in, empty out.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("doc"), "text")
    slim = stored(rows.select("id", "doc", F.octet_length("text").cast("long").alias("n_bytes")))
    own = slim.groupBy("doc", "id", "n_bytes").agg(F.count(F.lit(1)).alias("same"))
    own = own.groupBy("doc", "n_bytes").agg(F.sum("same").alias("n"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "same")).alias("first"))
    own = stored(own.select("doc", "n_bytes", "n", F.col("first.id").alias("keep"), F.col("first.same").alias("same")))

    found = stored(anchor_rows(rows.select("doc", "text")))
    # An anchor of one run, in however many copies of one text, needs no sorting.
    place = F.xxhash64("doc", "start")
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"), F.max(place).alias("other"), F.max("twice").alias("twice"))
    often = stored(often.where("one <> other OR twice").select("anchor", "n"))

    def contexts(some: DataFrame) -> DataFrame:
        picks = found.join(some.select("anchor"), "anchor").groupBy("doc").agg(F.collect_set("start").alias("picks"))
        return contexts_of(one_of_each(rows, picks.join(own.select("doc", "keep", "same"), "doc")).select("doc", "text", "picks"))

    ranges = sorted_ranges(contexts(often.where(F.col("n") <= hot)))
    if not often.where(F.col("n") > hot).isEmpty():
        ranges = ranges.unionByName(split_ranges(contexts(often.where(F.col("n") > hot))))
    # Texts that come more than once go whole, and need no ranges.
    alone = own.where("n = 1").select("doc", "keep", "same")
    ranges = ranges.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("ranges")).join(alone, "doc")
    cut = removed(one_of_each(rows, ranges).select("doc", "text", "ranges"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    zero = F.lit(0).cast("long")
    whole = own.where((F.col("n") > 1) & (F.col("n_bytes") >= SPAN)).select("doc", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.array(F.struct(zero.alias("a"), F.col("n_bytes").alias("b"))).alias("spans"))
    out = slim.join(stored(cut.unionByName(whole)), "doc", "left")
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("doc"))).alias("kept_sha256"), F.coalesce("spans", none).alias("spans")
    )


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return repeated_spans(docs.select("doc_id", "text")).drop("spans")
