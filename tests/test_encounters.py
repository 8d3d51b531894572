"""The data source of encounter files: several files, splits, inference, errors."""

import random

import pytest
from pyspark.sql import functions as F

from fieldmark.operators.fit import fit
from fieldmark.sources.encounters import individuals, read_encounters
from fieldmark.sources.histories import load

from grouped import rows


def write(path, lines, end="\n"):
    path.write_bytes(end.join(lines).encode())


def test_several_files_in_parts(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for k in range(5):
        own = [("".join(rng.choice("01") for _ in range(6)), rng.randrange(9), round(rng.random(), 3)) for _ in range(40 * k)]
        want += own
        write(tmp_path / f"f{k}.inp", ["/* a comment */", "", *[f"{'  ' * (i % 2)}{c} {n}  {x};{' /* é */' if i % 7 == 0 else ''}" for i, (c, n, x) in enumerate(own)], *[""] * (k % 2)], "\n" if k % 2 else "\r\n")
    write(tmp_path / "_hidden.inp", ["junk"])
    for size in (7, 64, 10**6):
        df = read_encounters(spark, str(tmp_path), covariates=["weight"], splitBytes=size)
        assert df.dtypes == [("ch", "string"), ("n", "bigint"), ("weight", "double")]
        assert sorted(map(tuple, df.collect())) == sorted(want)
    assert df.rdd.getNumPartitions() == 5
    assert read_encounters(spark, f"{tmp_path}/f[12].inp").count() == 120 and read_encounters(spark, f"file://{tmp_path}/f3.inp").columns == ["ch", "n", "x1"]


def test_groups_and_individuals(spark, tmp_path):
    write(tmp_path / "d.inp", ["0110 2 0;", "1001 1 3 ;", "0001 0 . ;"])
    df = read_encounters(spark, str(tmp_path / "d.inp"), groups=["male", "female"])
    assert [tuple(r) for r in df.orderBy("ch").collect()] == [("0001", 0, None), ("0110", 2, 0), ("1001", 1, 3)]
    got = individuals(df, ["male", "female"]).groupBy("ch", "group").count()
    assert {tuple(r) for r in got.collect()} == {("0110", "male", 2), ("1001", "male", 1), ("1001", "female", 3)}
    frame = load(spark, str(tmp_path / "d.inp"), groups=["male", "female"])
    assert frame.occasions == 4 and frame.covariates == ("group",) and frame.df.count() == 6
    with pytest.raises(Exception, match="removals"):
        individuals(df.withColumn("male", F.lit(-1)), ["male", "female"]).collect()


def test_a_fit_from_a_file(spark, tmp_path):
    """The published data, as counts of equal histories."""
    counts = {}
    for _, ch, _ in rows():
        counts[ch] = counts.get(ch, 0) + 1
    write(tmp_path / "dipper.inp", [f"{c} {n};" for c, n in counts.items()])
    assert fit(load(spark, str(tmp_path / "dipper.inp")))["log_likelihood"] == pytest.approx(-715.088085, abs=1e-5)


@pytest.mark.parametrize("lines,what", [(["010 1"], "no ';'"), (["0a0 1;"], "no detection history"), (["010 1;", "011 1 2;"], "fields"), ([""], "no records")])
def test_errors_name_the_place(spark, tmp_path, lines, what):
    write(tmp_path / "bad.inp", lines)
    with pytest.raises(Exception, match=what):
        read_encounters(spark, str(tmp_path / "bad.inp")).collect()
    with pytest.raises(Exception, match="no encounter files"):
        read_encounters(spark, str(tmp_path / "none.inp")).collect()
