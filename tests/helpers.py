"""Range frames from (start, end) pairs, and their results as sorted tuples."""


def frame(spark, pairs, space=0):
    rows = [(space, i, s, e) for i, (s, e) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, "space long, rid long, start long, end long")


def widths(spark, starts, sizes):
    return frame(spark, [(s, s + w - 1) for s, w in zip(starts, sizes, strict=True)])


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def ranges(df):
    return got(df, "start", "end")
