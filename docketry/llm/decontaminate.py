"""Benchmark decontamination by a prefix-filtered set join.

A window (a run of an item's words) occurs in a document only if all its shingles do, so one of them is enough to
find candidates: the rarest by its count over all documents. A document's shingles that belong to any item are kept
with their positions; joining the windows' prefix shingles with them gives the only starts where a window can stand,
within the document's bounds. There the whole window is compared, shingle by shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import ALNUM, ascii_lower, broadcast_up_to, merged, stored, words

#: Words of a window, words of a shingle at most, and bytes of a benchmark table up to which it is broadcast.
WINDOW, SHINGLE, BROADCAST_BYTES = 10, 3, 64 << 20


def shingles(ws: Column, size: Column, n: int) -> Column:
    """Hashes of the n-word shingles of an array with `size` elements, by position."""
    at = F.sequence(F.lit(0), size - n)
    return F.when(size >= n, F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(ws, i + F.lit(k)) for k in range(n)])))


def text_mark() -> Column:
    """With the id, what tells rows apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, shingle sizes' hashes) of each item's windows; null or empty items have none."""
    ws = items.select("item_id", words(F.col("text"), ALNUM).alias("ws")).withColumn("m", F.size("ws")).where("m > 0")
    starts = ws.select("item_id", "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("m") - window))).alias("s"))
    return starts.select("item_id", F.slice("ws", F.col("s") + 1, window).alias("ws")).distinct().withColumn("n", F.size("ws"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of `docs` (doc_id, text and any others) plus (n_words, n_hit, n_items, items_sha256).

    A document word is hit where it lies in an occurrence of a window. Null text or item has no words; an item of
    fewer words than a window is one window. Rows that repeat have the same result each. An item_id that repeats
    counts once. Empty documents give an empty result, an empty benchmark no hits. A window is compared by 64-bit
    hashes of all its shingles, so that words are told apart but for collisions of each of them at once. Tables of the
    benchmark of more than `broadcast_bytes` are shuffled instead.
    """
    names = docs.columns
    w = windows(items, window)
    kinds = sorted({min(SHINGLE, r["n"]) for r in w.select("n").distinct().collect()})  # 1 to SHINGLE
    w = w.withColumn("q", F.least(F.col("n"), F.lit(SHINGLE)))
    parts = F.lit(None).cast("array<bigint>")
    for q in kinds:
        parts = F.when(F.col("q") == q, shingles(F.col("ws"), F.col("n"), q)).otherwise(parts)
    w = w.select("item_id", "n", parts.alias("parts")).groupBy("n", "parts").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    w = stored(w.withColumn("window", F.xxhash64("n", "parts")))
    known = w.select(F.explode("parts").alias("part")).distinct()
    names_of = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    sizes = w.agg(F.sum(F.size("parts") * 8 + 64).alias("parts"), F.sum(names_of + 64).alias("items")).first()  # measured, so that no broadcast grows unseen
    of_parts, of_items = sizes["parts"] or 0, sizes["items"] or 0

    # Every place in a document where a shingle of the benchmark stands. The documents' words are read once for it.
    doc = docs.select(text_mark().alias("mark"), F.col("doc_id").alias("id"), words(F.col("text"), ALNUM).alias("ws")).withColumn("m", F.size("ws"))
    found = None
    for q in kinds:
        one = doc.select("mark", "id", "m", F.posexplode(shingles(F.col("ws"), F.col("m"), q)).alias("at", "part"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        hit = docs.sparkSession.createDataFrame([], "mark bigint, id bigint, n_hit int, items array<string>")
    else:
        places = stored(found.join(broadcast_up_to(known, 4 * of_parts, broadcast_bytes), "part").distinct())
        seen = places.groupBy("part").agg(F.count(F.lit(1)).alias("seen"))
        tokens = w.select("window", F.posexplode("parts").alias("offset", "part")).join(broadcast_up_to(seen, of_parts, broadcast_bytes), "part", "left")
        rarest = Window.partitionBy("window").orderBy(F.coalesce("seen", F.lit(0)), "part", "offset")
        prefix = tokens.withColumn("r", F.row_number().over(rarest)).where("r = 1").select("window", "offset", "part")
        prefix = broadcast_up_to(prefix.join(broadcast_up_to(w.select("window", "n", "parts"), of_parts, broadcast_bytes), "window"), of_parts, broadcast_bytes)
        starts = places.join(prefix, "part").withColumn("start", F.col("at") - F.col("offset"))
        starts = starts.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("m")))
        need = starts.select("mark", "id", "start", "n", "window", F.size("parts").alias("of"), F.posexplode("parts").alias("k", "part"))
        need = need.withColumn("at", F.col("start") + F.col("k")).alias("need")
        there = places.select("mark", "id", "at", "part").alias("there")
        same = (F.col("need.mark") == F.col("there.mark")) & F.col("need.id").eqNullSafe(F.col("there.id")) & (F.col("need.at") == F.col("there.at")) & (F.col("need.part") == F.col("there.part"))
        whole = need.join(merged(there), same).select("need.*").groupBy("mark", "id", "start", "n", "window", "of").agg(F.count(F.lit(1)).alias("have")).where("have = of")
        whole = whole.join(broadcast_up_to(w.select("window", "items"), of_items, broadcast_bytes), "window")
        hit = whole.groupBy("mark", "id").agg(
            F.collect_set(F.struct("start", "n")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
        hit = hit.select("mark", "id", F.size(covered).alias("n_hit"), "items")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.regexp_count(ascii_lower(F.col("text")), F.lit(ALNUM)).cast("long").alias("n_words"), F.col("doc_id").alias("_id"), text_mark().alias("_mark"))
    joined = base.join(hit, (F.col("_mark") == hit["mark"]) & F.col("_id").eqNullSafe(hit["id"]), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        *[F.col("row")[c].alias(c) for c in names],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
    )


def decontaminate_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated); options as of `contaminated`."""
    found = contaminated(docs.select("doc_id", "text"), items, **options)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
