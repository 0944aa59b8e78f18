"""A mask whose ranges go over the width that its ratios are taken of."""

import pytest
from helpers import frame

from rangeloom.operators import masks


def test_beyond(spark):
    ranges = frame(spark, [(1, 5), (8, 30)]).select("start", "end")
    assert masks.mask(spark, 20, ranges, name="m", beyond=True).measured().first()[:] == (1, "m", True, 28, 1.4, 1, 30)
    with pytest.raises(Exception, match="must be normal"):
        masks.mask(spark, 20, ranges).measured().collect()
    with pytest.raises(Exception, match="must be normal"):
        masks.mask(spark, 20, frame(spark, [(1, 5), (6, 30)]).select("start", "end"), beyond=True).measured().collect()
