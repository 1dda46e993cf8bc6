"""Operators over any DataFrame: collapse, facets, pages, upserts, snapshot changes and their kin.

Each is a plan of built-in expressions; none runs a job. Orders always end in a tie-break that the caller names, so
that results do not depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(predicates: Iterable[Column | None]) -> Column:
    """Conjunction of the predicates that are given; a None is a parameter that was left out."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def equals(column: str, value: object | None) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def one_of(column: str, values: Sequence[object] | None) -> Column | None:
    return None if not values else F.col(column).isin(list(values))


def overlaps(column: str, values: Sequence[str] | None) -> Column | None:
    """Whether an array shares an element with the values; an empty or null array shares none."""
    return None if not values else F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False))


def has(column: str, value: object | None) -> Column | None:
    return None if value is None else F.coalesce(F.array_contains(F.col(column), F.lit(value)), F.lit(False))


def contains_ignoring_case(column: str, part: str | None) -> Column | None:
    """Substring without regard to case; % and _ stand for themselves."""
    return None if part is None else F.contains(F.lower(F.col(column)), F.lit(part.lower()))


def any_contains(columns: Sequence[str], part: str | None) -> Column | None:
    """Substring in any of the columns without regard to case; a null column has none."""
    return None if part is None else reduce(lambda a, b: a | b, [F.coalesce(contains_ignoring_case(c, part), F.lit(False)) for c in columns])


def tagged(column: str, prefix: str, value: str | None) -> Column | None:
    """Whether an array of tags has a value, with its prefix or bare."""
    return None if value is None else F.coalesce(F.arrays_overlap(F.col(column), F.array(F.lit(f"{prefix}:{value}"), F.lit(value))), F.lit(False))


def sponsored(sponsors: str, who: str | int | None) -> Column | None:
    """Bills of a sponsor: of an id, or of an exact last name or a part of the joined names, without regard to case."""
    if who is None:
        return None
    if isinstance(who, int):
        return F.exists(F.transform(sponsors, lambda s: s["people_id"]), lambda i: i == who)
    names = F.lower(F.array_join(F.transform(sponsors, lambda s: s["name"]), ", "))
    return F.exists(sponsors, lambda s: F.lower(s["last_name"]) == who.lower()) | F.contains(names, F.lit(who.lower()))


def without_forbidden(asked: Mapping[str, object], forbidden: Sequence[str] = ("visibility", "allowed_roles", "allowed_users")) -> Mapping[str, object]:
    """The caller's arguments; those that would set permissions raise ValueError."""
    wrong = sorted(set(asked) & set(forbidden))
    if wrong:
        raise ValueError(f"not for callers to say: {', '.join(wrong)}")
    return asked


def merged_hits(parts: Sequence[DataFrame], score: str, key: str, size: int) -> DataFrame:
    """The best hits of several searches together; one that several found counts once, with its best score."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return page(collapse(every, [key], [F.col(score).desc()]), [F.col(score).desc(), F.col(key)], size)


def within(column: str, first: object | None, last: object | None) -> Column:
    """Inclusive range with either end open."""
    return all_of([None if first is None else F.col(column) >= F.lit(first), None if last is None else F.col(column) <= F.lit(last)])


def window_from(column: str, as_of: Column, hours: int = 72) -> Column:
    """From `as_of` to so many hours later, inclusive."""
    return (F.col(column) >= as_of) & (F.col(column) <= as_of + F.make_interval(hours=F.lit(hours)))


def visible_to(roles: Sequence[str], user: str, visibility: str = "visibility", allowed_roles: str = "allowed_roles", allowed_users: str = "allowed_users") -> Column:
    """Row-level security: public, or granted to a role or to the user."""
    mine = F.array(*map(F.lit, roles)) if roles else F.array().cast("array<string>")
    return F.coalesce((F.col(visibility) == "public") | F.arrays_overlap(F.col(allowed_roles), mine) | F.array_contains(F.col(allowed_users), user), F.lit(False))


def collapse(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], keep: int = 1, rank: str | None = None) -> DataFrame:
    """The first `keep` rows of each key in the order; their place is kept as the column `rank` if that is named."""
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= keep)
    return placed.withColumnRenamed("_place", rank) if rank else placed.drop("_place")


def inner_hits(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], n: int = 2) -> DataFrame:
    """The n rows after the first of each key, with their place from 1; null keys have none."""
    some = df.where(reduce(lambda a, b: a & b, [(F.col(k) if isinstance(k, str) else k).isNotNull() for k in keys]))
    return collapse(some, keys, order, n + 1, "hit").where("hit > 1").withColumn("hit", F.col("hit") - 1)


def facets(df: DataFrame, scalars: Mapping[str, str | Column], arrays: Mapping[str, str | Column] | None = None, top: Mapping[str, int] | None = None) -> DataFrame:
    """(facet, key, n) for every facet in one pass: each row is exploded into its facets' keys.

    Array facets count each distinct element. `top` keeps the largest keys of a facet, ties by key.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    one = [F.struct(F.lit(name).alias("facet"), col(c).cast("string").alias("key")) for name, c in scalars.items()]
    many = [_elements(name, col(c)) for name, c in (arrays or {}).items()]
    pairs = F.concat(F.array(*one), *many) if one else F.concat(*many)
    counted = df.select(F.explode(pairs).alias("f")).select("f.facet", "f.key").where("key IS NOT NULL").groupBy("facet", "key").agg(F.count(F.lit(1)).alias("n"))
    if not top:
        return counted
    limits = F.create_map(*[F.lit(x) for kv in top.items() for x in kv])
    placed = counted.withColumn("_place", F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "key")))
    return placed.where(F.col("_place") <= F.coalesce(F.try_element_at(limits, F.col("facet")), F.lit(2**31 - 1))).drop("_place")


def _elements(name: str, values: Column) -> Column:
    return F.transform(F.array_distinct(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>"))), lambda x: F.struct(F.lit(name).alias("facet"), x.alias("key")))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, at: str, key: str, limit: int, cursor: tuple[object, object] | None = None) -> DataFrame:
    """Newest first, from after the cursor; one row more than the limit tells that a page follows."""
    if cursor is not None:
        df = df.where(F.struct(F.col(at), F.col(key)) < F.struct(F.lit(cursor[0]).cast(df.schema[at].dataType), F.lit(cursor[1]).cast(df.schema[key].dataType)))
    return df.orderBy(F.col(at).desc(), F.col(key).desc()).limit(limit + 1)


def nest(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array of structs, empty where there are none."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    made = children.groupBy(key).agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias(name))
    return parents.join(made, key, "left").withColumn(name, F.coalesce(F.col(name), F.array()))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """New rows replace old ones of the same key; of several new ones the first in `order` counts."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return collapse(both, list(keys), [F.col("_new").desc(), *order]).drop("_new")


def snapshot_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys of either snapshot with `change`: added, removed, changed or same, nulls being equal to each other."""
    left = old.select(*keys, F.struct(*columns).alias("_old"))
    right = new.select(*keys, F.struct(*columns).alias("_new"))
    both = left.join(right, list(keys), "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def requeue(old: DataFrame, new: DataFrame, key: str, digest: str, status: str, columns: Sequence[str] = ()) -> DataFrame:
    """Upsert whose status goes back to `pending` where the digest changed; other columns keep old values for null ones."""
    o = old.select(F.col(key), F.col(digest).alias("_digest"), F.col(status).alias("_status"), *[F.col(c).alias(f"_old_{c}") for c in columns])
    both = o.join(new.select(key, digest, *columns), key, "full_outer")
    kept = F.when(F.col(digest).isNull(), F.col("_status")).when(~F.col(digest).eqNullSafe(F.col("_digest")), "pending").otherwise(F.col("_status"))
    return both.select(key, F.coalesce(digest, "_digest").alias(digest), kept.alias(status), *[F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in columns])


def soft_delete(rows: DataFrame, seen: DataFrame, key: str, at: str, as_of: Column, flag: str = "cancelled") -> DataFrame:
    """All rows; those not seen again, not yet flagged and later than `as_of` become flagged."""
    mark = seen.select(F.col(key)).distinct().withColumn("_seen", F.lit(True))
    gone = F.col("_seen").isNull() & ~F.col(flag) & (F.col(at) > as_of)
    return rows.join(mark, key, "left").withColumn(flag, F.col(flag) | F.coalesce(gone, F.lit(False))).drop("_seen")


def delete_where(rows: DataFrame, predicate: Column, except_keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows without those of the predicate, but for keys that are excepted."""
    doomed = rows.where(F.coalesce(predicate, F.lit(False)))
    kept = rows.where(~F.coalesce(predicate, F.lit(False)))
    return kept if except_keys is None else kept.unionByName(doomed.join(except_keys.select(key).distinct(), key, "left_semi"))


def replace_group(index: DataFrame, fresh: DataFrame, group: str) -> DataFrame:
    """An index in which the fresh rows stand for all rows of their groups."""
    return index.join(fresh.select(group).distinct(), group, "left_anti").unionByName(fresh, allowMissingColumns=True)


def running_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "occurrence") -> DataFrame:
    """How many rows of the key there are up to each row."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], tie: str) -> DataFrame:
    """Each left row with the columns of the latest right row of its keys at or before it; nulls where there is none.

    Both sides are laid in one order and values carried forward: one shuffle on the keys, and no pairs are made.
    """
    names = [f.name for f in left.schema.fields]
    shape = [F.struct(F.col(at), *[F.col(c) for c in columns]).alias("_right")]
    l = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.struct(*names).alias("_left"))  # noqa: E741
    r = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), *shape)
    both = l.unionByName(r, allowMissingColumns=True)
    both = carry_forward(both, list(keys), [F.col("_at"), F.col("_side"), F.col("_tie")], F.col("_right"), "_match")
    return both.where("_side = 1").select("_left.*", *[F.col(f"_match.{c}").alias(f"{c}_asof") for c in columns])


def unconsumed(events: DataFrame, consumed: DataFrame, key: str) -> DataFrame:
    return events.join(consumed.select(key), key, "left_anti")


def prefix_rollup(df: DataFrame, path: Column, separator: str, names: Sequence[str]) -> DataFrame:
    """(level, prefix, n) of each level of a separated path: the whole, then one part less at a time."""
    parts = F.split(path, separator)
    levels = [F.struct(F.lit(name).alias("level"), F.when(F.size(parts) >= k, F.array_join(F.slice(parts, 1, k), " ")).alias("prefix")) for k, name in enumerate(names, 1)]
    return df.select(F.explode(F.array(*levels)).alias("p")).select("p.level", "p.prefix").where("prefix IS NOT NULL").groupBy("level", "prefix").agg(F.count(F.lit(1)).alias("n"))


def dotted_key(cite: Column) -> Column:
    """Sort key of a dotted citation: its parts padded to six, so that 9.2 stands before 9.10."""
    return F.array_join(F.transform(F.split(cite, "[.]"), lambda p: F.lpad(p, 6, "0")), ".")


def cell_changes(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Cells of two tables whose values differ, an absent cell being null: (keys, before, after)."""
    both = a.select(*keys, F.col(value).alias("before")).join(b.select(*keys, F.col(value).alias("after")), list(keys), "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def pair_sum(a: Column, b: Column) -> Column:
    """Sum of two with an absent one as 0; null where both are absent."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def near(a: Column, b: Column, eps: float = 0.5) -> Column:
    return F.abs(a - b) <= F.lit(eps)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left id, right id, score) of every pair of rows that share a word and whose Jaccard similarity is at least `least`.

    Both sides are (id, array of distinct words); a row is told by its id and words, and no row stands twice. Rows with
    a null id have no pairs. Shared words are counted, not intersected: a join on the word and one aggregation, whose
    partial counts form before the shuffle. Sizes that can't reach `least` drop out in the join.
    """
    (x, a), (y, b) = left.columns, right.columns
    own = left.where(F.col(x).isNotNull()).select(F.col(x).alias("_x"), F.xxhash64(a).alias("_mx"), F.size(a).alias("_na"), F.explode(a).alias("_w"))
    other = right.where(F.col(y).isNotNull()).select(F.col(y).alias("_y"), F.xxhash64(b).alias("_my"), F.size(b).alias("_nb"), F.explode(b).alias("_w"))
    met = own.join(other, "_w").where((F.col("_na") >= F.lit(least) * F.col("_nb")) & (F.col("_nb") >= F.lit(least) * F.col("_na")))
    shared = met.groupBy("_x", "_mx", "_na", "_y", "_my", "_nb").agg(F.count(F.lit(1)).alias("_n"))
    score = F.col("_n") / (F.col("_na") + F.col("_nb") - F.col("_n")).cast("double")
    return shared.select(F.col("_x").alias(x), F.col("_y").alias(y), score.alias("score")).where(F.col("score") >= least)


def first_of_each(df: DataFrame, digest: Column, order: Sequence[Column]) -> DataFrame:
    """The first row of each digest."""
    return collapse(df.withColumn("_digest", digest), ["_digest"], order).drop("_digest")


def latest_code(versions: DataFrame, key: str, code: str, seq: str) -> DataFrame:
    """The current version of each key: that of the highest sequence."""
    return versions.groupBy(key).agg(F.max_by(code, seq).alias(code))


def latest_and_next(versions: DataFrame, key: str, code: str, seq: str) -> DataFrame:
    """`latest_code` and `next_version` by the same sequence, from one reading of the versions."""
    return versions.groupBy(key).agg(F.max_by(code, seq).alias(code), (F.max(seq) + 1).alias("next_version"))


def next_version(rows: DataFrame, key: str, version: str = "version") -> DataFrame:
    return rows.groupBy(key).agg((F.max(version) + 1).alias("next_version"))
