"""Groupings: objects in groups, partitionings, splits and what is computed by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sweep import preceding, running
from ..sources.scratch import kept

# ---- partitionings ---------------------------------------------------------------------------------------------------


def by_width(groups: DataFrame, width: str = "width") -> DataFrame:
    """Blocks one behind the other from a table (group_id, width): adds start and end."""
    out = running(groups, {"end": ("sum", F.col(width).cast("long"))}, "group_id", ["group_id"], by=(), derived=True)
    return out.withColumn("start", F.col("end") - F.col(width) + 1)


def by_end(groups: DataFrame, end: str = "end") -> DataFrame:
    """Blocks from a table (group_id, end); ends must not fall."""
    from ..model import fail_if

    out = preceding(groups, {"_end": F.col(end)}, "group_id", ["group_id"], by=())
    before = F.coalesce("_end", F.lit(0))
    return out.withColumn("start", fail_if(F.col(end) < before, "ends must not fall", before + 1)).drop("_end")


def tabulated(members: DataFrame, n: int, group: str = "group_id") -> DataFrame:
    """Members' group numbers (1 to n, else an error) as a table group_id, width with all n groups."""
    from ..model import fail_if

    checked = members.select(fail_if((F.col(group) < 1) | (F.col(group) > n), "a group number is out of range", F.col(group)).alias("group_id"))
    counts = checked.groupBy("group_id").agg(F.count(F.lit(1)).alias("width"))
    levels = members.sparkSession.range(1, n + 1).select(F.col("id").alias("group_id"))
    return levels.join(counts, "group_id", "left").withColumn("width", F.coalesce("width", F.lit(0)))


def lengths(members: DataFrame, group: str = "group_id") -> DataFrame:
    return members.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def members(frame: DataFrame, groups: Sequence, group: str = "group_id", member: str = "member_id") -> DataFrame:
    """The sorted members of the given groups, a list for each."""
    return frame.filter(F.col(group).isin(list(groups))).groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("members"))


def with_group_length(frame: DataFrame, group: str = "group_id") -> DataFrame:
    """Each member with the size of its group."""
    return frame.join(lengths(frame, group).withColumnRenamed("n", "group_length"), group)


def high_to_low(frame: DataFrame, value: str) -> DataFrame:
    """Per row: low, the first row with the same value where that is another (else null)."""
    first = frame.groupBy(value).agg(F.min("rid").alias("_first"))
    return frame.join(first, frame[value].eqNullSafe(first[value])).select(frame["*"], F.when(F.col("_first") < F.col("rid"), F.col("_first")).alias("low"))


def low_to_high(frame: DataFrame, value: str) -> DataFrame:
    """Per first row of a value: the later rows with the same value."""
    rows = high_to_low(frame, value).filter("low is not null")
    return rows.groupBy(F.col("low").alias("rid")).agg(F.array_sort(F.collect_list("rid")).alias("high"))


def dense_groups(frame: DataFrame, value: str) -> DataFrame:
    """Each row's group number and its rank: groups are counted in the order of their first rows."""
    first = frame.groupBy(value).agg(F.min("rid").alias("_first"))
    ranked = running(first, {"group_rank": ("sum", F.lit(1).cast("long"))}, "_first", ["_first"], by=(), derived=True)
    return frame.join(ranked, frame[value].eqNullSafe(ranked[value])).select(frame["*"], F.col("_first").alias("representative"), "group_rank")


def crossed(frame: DataFrame, factors: Sequence[str], member: str = "rid", *, most: int = 1_000_000, empty: bool = True) -> DataFrame:
    """Members by every combination of the factors' levels, empty ones included: as many rows as the numbers of levels
    multiplied, which must not be over ``most``.  Without ``empty``, only the combinations that have members."""
    some = frame
    for f in factors:
        some = some.filter(F.col(f).isNotNull())
    found = some.groupBy(*factors).agg(F.array_sort(F.collect_list(member)).alias("members"))
    if not empty:
        return found
    n = 1
    for k in frame.agg(*[F.count_distinct(f) for f in factors]).first():
        n *= k
    if n > most:
        raise ValueError(f"{n} combinations of levels; at most {most} are listed")
    levels = None
    for f in factors:
        own = frame.select(f).filter(F.col(f).isNotNull()).distinct()
        levels = own if levels is None else levels.crossJoin(F.broadcast(own))
    return levels.join(found, list(factors), "left").withColumn("members", F.coalesce("members", F.array().cast("array<long>")))


def truncated(frame: DataFrame, n: int) -> DataFrame:
    return frame.filter(F.col("rid") <= n)


def hits_by_query(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's sorted subjects as a list; queries without hits have an empty one."""
    lists = hits.groupBy("space", "query_id").agg(F.array_sort(F.collect_list("subject_id")).alias("subjects"))
    return queries.select("space", F.col("rid").alias("query_id")).join(lists, ["space", "query_id"], "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<long>")))


def mapped_order(parts: DataFrame, order: str = "map_order") -> DataFrame:
    """A partitioning with a stored order of its objects: the place of each object."""
    return running(parts, {"place": ("sum", F.lit(1).cast("long"))}, order, [order], by=())


# ---- splits ----------------------------------------------------------------------------------------------------------


def split(frame: DataFrame, by: Sequence[str], value: Column | str, *, levels: DataFrame | None = None) -> DataFrame:
    """Values by group as lists in row order; rows with a null key go.  With ``levels`` (the key columns) groups without
    rows are kept, empty."""
    some = frame
    for k in by:
        some = some.filter(F.col(k).isNotNull())
    v = F.col(value) if isinstance(value, str) else value
    lists = some.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rid", v.alias("v")))), lambda x: x["v"]).alias("values"))
    if levels is None:
        return lists
    kind = dict(lists.dtypes)["values"]
    return levels.join(lists, list(by), "left").withColumn("values", F.coalesce("values", F.array().cast(kind)))


def multisplit(frame: DataFrame, keys: str, value: Column | str) -> DataFrame:
    """Split by a list of keys per row: a row goes to each of its groups."""
    return split(frame.withColumn("key", F.explode(keys)), ["key"], value)


def unsplit(lists: DataFrame, by: Sequence[str]) -> DataFrame:
    """The values of split lists as rows: key columns, place, value."""
    return lists.select(*by, F.posexplode("values").alias("place", "value")).withColumn("place", F.col("place") + 1)


def placed(frame: DataFrame, by: Sequence[str], order: str = "rid", name: str = "place") -> DataFrame:
    """Split in long form, for groups of any size: each row's place in its group, in row order; rows with a null key go."""
    some = frame
    for k in by:
        some = some.filter(F.col(k).isNotNull())
    return running(some, {name: ("sum", F.lit(1).cast("long"))}, order, [order], by=tuple(by))


def in_line(frame: DataFrame, group: str, order: str = "rid", name: str = "pos") -> DataFrame:
    """All groups one behind the other: each row's place in that line (groups in order, then rows)."""
    widths = by_width(frame.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(F.count(F.lit(1)).alias("width")))
    rows = placed(frame, [group], order, name).join(widths.select(F.col("group_id").alias(group), F.col("start").alias("_first")), group)
    return rows.withColumn(name, F.col(name) + F.col("_first") - 1).drop("_first")


def fragmented(rows: DataFrame, cuts: DataFrame, pos: str = "pos") -> DataFrame:
    """Long lists cut by disjoint ranges (rid, start, end) over the line of their elements: adds range_id; elements in
    no range go."""
    from .nearest import find_run

    line = lambda df, *more: df.select(F.lit(0).cast("long").alias("space"), *more)
    hit = find_run(line(rows, F.col(pos).alias("rid"), F.col(pos).alias("pos")), line(cuts.filter("end >= start"), "start", "end", F.col("rid").alias("value")))
    return rows.join(hit.filter("value is not null").select(F.col("rid").alias(pos), F.col("value").alias("range_id")), pos)


def regrouped(rows: DataFrame, groups: DataFrame, group: str = "group_id", super_: str = "super_id", order: str = "rid") -> DataFrame:
    """Long lists put together by a map (group, super): adds super and each row's place in it, groups in order."""
    inner = placed(rows.join(groups, group), [group], order, "_place")
    counts = inner.groupBy(super_, group).agg(F.count(F.lit(1)).alias("_n"))
    before = running(counts, {"_before": ("sum", F.col("_n"))}, group, [group], before=["_before"], by=(super_,), derived=True)
    return inner.join(before.select(super_, group, "_before"), [super_, group]).withColumn("place", F.col("_place") + F.col("_before")).drop("_place", "_before")


def assigned(frame: DataFrame, by: Sequence[str], new: DataFrame, value: str = "value") -> DataFrame:
    """Split assignment: the values of each group replaced, in row order, by those of ``new`` (key columns, place, value).

    A group's new values are used again from the first if they are fewer; groups without new values keep theirs.
    """
    counts = new.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = placed(frame, by, "rid", "_k").join(counts, list(by), "left").withColumn("place", F.when(F.col("_n") > 0, F.pmod(F.col("_k") - 1, F.col("_n")) + 1))
    fresh = new.select(*by, F.col("place").cast("long").alias("place"), F.struct(F.col(value).alias("v")).alias("_new"))
    out = rows.join(fresh, [*by, "place"], "left").withColumn(value, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(value)))
    return out.select(*frame.columns)


def relist(flat: DataFrame, skeleton: DataFrame, value: str = "value") -> DataFrame:
    """A flat vector (rid, value) cut into lists like a partitioning (group_id, start, end)."""
    expanded = skeleton.filter("end >= start").select("group_id", F.explode(F.sequence("start", "end")).alias("rid"))
    lists = split(expanded.join(flat, "rid"), ["group_id"], value)
    kind = dict(lists.dtypes)["values"]
    return skeleton.select("group_id").join(lists, "group_id", "left").withColumn("values", F.coalesce("values", F.array().cast(kind)))


def extract(flat: DataFrame, wanted: DataFrame, value: str = "value") -> DataFrame:
    """Gather from a vector (rid, value) by lists of places (group_id, places)."""
    at = wanted.select("group_id", F.posexplode("places").alias("_p", "rid"))
    got = at.join(flat, "rid").groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", value))), lambda x: x[value]).alias("values"))
    kind = dict(got.dtypes)["values"]
    return wanted.select("group_id").join(got, "group_id", "left").withColumn("values", F.coalesce("values", F.array().cast(kind)))


def apply(frame: DataFrame, by: Sequence[str], function, schema: str) -> DataFrame:
    """A Python function from each group's pandas frame to a frame of ``schema``; a group must fit a task."""
    return frame.groupBy(*by).applyInPandas(function, schema)


def apply_in_parts(frame: DataFrame, by: Sequence[str], function, schema: str, *, parts: int = 64) -> DataFrame:
    """A Python function for groups of any size, which must give the same from its results on a group's parts as from the
    whole group (a top-k, a sum): it runs on each of ``parts`` parts and then once more on what they give."""
    salted = frame.withColumn("_salt", F.pmod(F.xxhash64(*frame.columns), F.lit(parts))).groupBy(*by, "_salt")
    return salted.applyInPandas(lambda pdf: function(pdf.drop(columns=["_salt"])), schema).groupBy(*by).applyInPandas(function, schema)


def tapply(frame: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates by one or more factors."""
    return frame.groupBy(*by).agg(*[e.alias(k) for k, e in aggregates.items()])


def regroup(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Lists (group_id, values) put together by a map (group_id, super_id), in order of group."""
    joined = lists.join(groups, "group_id").groupBy("super_id").agg(F.array_sort(F.collect_list(F.struct("group_id", "values"))).alias("_l"))
    return joined.select("super_id", F.flatten(F.transform("_l", lambda x: x["values"])).alias("values"))


def fragments(lists: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pieces of lists cut by ranges over all their elements in a row: list, range, values.

    ``lists`` has group_id and values, ``cuts`` disjoint ranges (rid, start, end).  Offsets are a running sum, each
    list meets the ranges that it overlaps, and its part is sliced out.
    """
    from .overlaps import find

    sized = kept(by_width(lists.select("group_id", F.size("values").cast("long").alias("width"))), "sized")
    line = lambda df, key: df.select(F.lit(0).cast("long").alias("space"), F.col(key).alias("rid"), "start", "end")
    hits = find(line(sized.filter("width > 0"), "group_id"), line(cuts, "rid"))
    out = hits.select(F.col("query_id").alias("group_id"), F.col("subject_id").alias("rid")).join(sized, "group_id").join(cuts.select("rid", F.col("start").alias("_s"), F.col("end").alias("_e")), "rid").join(lists.select("group_id", "values"), "group_id")
    first = F.greatest("start", "_s") - F.col("start") + 1
    size = F.least("end", "_e") - F.greatest("start", "_s") + 1
    return out.select("group_id", F.col("rid").alias("range_id"), F.slice("values", first.cast("int"), size.cast("int")).alias("values"))


# ---- tables in groups ------------------------------------------------------------------------------------------------


def contingency(lists: DataFrame, key: str, values: str = "values") -> DataFrame:
    """How often each list holds each value: key, value, n."""
    return lists.select(key, F.explode(values).alias("value")).groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))


def stacked(frames: dict[str, DataFrame], name: str = "name") -> DataFrame:
    """Tables one under the other with their names; columns that one lacks are null."""
    out = None
    for key, df in frames.items():
        part = df.withColumn(name, F.lit(key))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def bound(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tables side by side, group by group and row by row."""
    return left.join(right, list(by))


def dims(frame: DataFrame, by: str) -> DataFrame:
    """Rows and columns of each group's table."""
    return frame.groupBy(by).agg(F.count(F.lit(1)).alias("nrows")).withColumn("ncols", F.lit(len(frame.columns) - 1))


def renamed(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    return frame.withColumnsRenamed(names)


def described(frame: DataFrame, column: str, **facts: str) -> DataFrame:
    """Metadata on a column, kept in the schema."""
    return frame.withMetadata(column, facts)


def transformed(frame: DataFrame, **columns: Column) -> DataFrame:
    """New columns from expressions, the later ones may use the earlier."""
    for k, e in columns.items():
        frame = frame.withColumn(k, e)
    return frame


def selection(frame: DataFrame, at: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that overlap given ranges, and some of their columns."""
    from .overlaps import subset

    return subset(frame, at).select("space", "rid", *columns)
