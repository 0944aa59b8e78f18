"""Mask readers, masks and the entry points."""

import pytest
from helpers import ranges

import __spark_entry__
from rangeloom.sources import masks as readers


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_agp(spark, tmp_path):
    path = write(tmp_path, "a.agp", "# comment\nchrY\t1\t100\t1\tN\t100\tcontig\tno\nchrY\t101\t200\t2\tF\tX\t1\t100\t+\nchrY\t201\t300\t3\tN\t100\tclone\tno\n")
    assert ranges(readers.agp(spark, path)) == [(1, 100), (201, 300)]
    mask = readers.read_mask(spark, path, "agp", seqname="chrY", width=500)
    assert [(r.start, r.end) for r in mask.gaps().ranges.orderBy("start").collect()] == [(101, 200), (301, 500)]
    assert ranges(readers.read_mask(spark, path, "agp", seqname="chrY", width=500, gap_types=["clone"]).ranges) == [(201, 300)]
    with pytest.raises(ValueError, match="chrY"):
        readers.read_mask(spark, path, "agp", seqname="?")
    with pytest.warns(UserWarning):
        assert readers.read_mask(spark, path, "agp", seqname="chrX", width=9).ranges.collect() == []
    with pytest.raises(ValueError):
        readers.read_mask(spark, path, "agp", seqname="chrX")
    bad = write(tmp_path, "b.agp", "chrY\t1\t100\t1\tN\t99\tcontig\tno\n")
    with pytest.raises(Exception, match="disagree"):
        readers.agp(spark, bad).collect()


def test_gap_table(spark, tmp_path):
    eight = write(tmp_path, "8", "chr1\t0\t100\t1\tN\t100\ttelomere\tno\n")
    nine = write(tmp_path, "9", "585\tchr1\t0\t100\t1\tN\t100\ttelomere\tno\n")
    assert ranges(readers.ucsc_gap(spark, eight)) == ranges(readers.ucsc_gap(spark, nine)) == [(1, 100)]


def test_lift(spark, tmp_path):
    path = write(tmp_path, "l", "10\tc1\t20\tchr1\t100\n50\tc2\t10\tchr1\t100\n")
    assert ranges(readers.lift(spark, path)) == [(1, 10), (31, 50), (61, 100)]
    bad = write(tmp_path, "m", "10\tc1\t20\tchr1\t100\n50\tc2\t10\tchr1\t101\n")
    with pytest.raises(Exception, match="two lengths"):
        readers.lift(spark, bad).collect()


def test_repeats(spark, tmp_path):
    text = "   SW  perc\nscore  div.\n\n  100  1.0  0.0  0.0  chrM  5  9  (3)  +  a  b  1  2  (3)  7\n"
    rows = readers.repeat_masker(spark, write(tmp_path, "r", text)).collect()
    assert [(r.seqname, r.start, r.end, r.id) for r in rows] == [("chrM", 5, 9, "7")]
    assert ranges(readers.tandem_repeats(spark, write(tmp_path, "t", "chrM\t4\t9\ttrf" + "\t1" * 12 + "\n"))) == [(5, 9)]


def test_entry_points(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert __spark_entry__.entry(spark).limit(1).count() == 1
