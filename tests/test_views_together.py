"""Python functions over many whole views at once."""

from helpers import frame
from pyspark.sql import functions as F

from rangeloom.operators import views


def test_a_function_gets_many_whole_views(spark):
    runs = spark.range(0, 500).select(F.lit(0).cast("long").alias("space"), (F.col("id") * 2 + 1).alias("start"), (F.col("id") * 2 + 2).alias("end"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("value"))
    ranges = [(a, a + a % 11 - 1) for a in range(1, 900)]

    def told(pdf):
        g = pdf.groupby(["space", "rid"], sort=False)
        return g.agg(n=("pos", "size"), first=("pos", "min"), top=("value", "max")).reset_index().assign(views=g.ngroups)

    rows = views.apply_python(frame(spark, ranges), runs, told, "space long, rid long, n long, first long, top double, views long", together=True).collect()
    value = lambda p: (p - 1) // 2 if (p - 1) // 2 % 7 else None
    seen = {i: [value(p) for p in range(a, z + 1)] for i, (a, z) in enumerate(ranges, 1) if z >= a}
    assert {r.rid: (r.n, r.first, r.top) for r in rows} == {i: (len(v), ranges[i - 1][0], max((x for x in v if x is not None), default=None)) for i, v in seen.items()}
    assert len(rows) == len(seen) and max(r.views for r in rows) > 50
