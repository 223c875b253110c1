"""Files with quoted line breaks: the same rows as Spark's multi-line reader, with breaks at the borders of byte ranges."""

import os
import random

import pytest

from driftwatch.sources import quoted
from driftwatch.sources.csv import READ_OPTIONS, read_delimited


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few dozen bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "61")
    spark.conf.set(keys[1], "0")
    spark.conf.set(keys[2], "1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def whole(spark, path, sep=","):
    return spark.read.options(**READ_OPTIONS).option("sep", sep).option("multiLine", "true").csv(path)


def same(spark, path, sep=","):
    key = lambda r: [("" if x is None else x, x is None) for x in r]
    got = sorted((tuple(r) for r in read_delimited(spark, path, sep, multiline=True).collect()), key=key)
    want = sorted((tuple(r) for r in whole(spark, path, sep).collect()), key=key)
    assert got == want
    return got


def field(rng):
    x = "".join(rng.choice(['a', 'b', '7', ' ', ',', '"', '\n', 'é', '|']) for _ in range(rng.randrange(0, 14)))
    return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') or rng.random() < 0.3 else x


@pytest.mark.parametrize("seed", range(2))
def test_same_rows_as_the_multiline_reader(spark, tmpdir_path, small_ranges, seed):
    rng = random.Random(seed)
    rows = [",".join([f"r{i}", field(rng), field(rng)]) for i in range(60)]
    p = write(os.path.join(tmpdir_path, "x.csv"), "id,one,two\n" + "\n".join(rows) + "\n")
    assert quoted.layout(spark, p, ",") == quoted.BROKEN
    assert len({r["start"] for r in quoted.file_lines(spark, p).select("start").distinct().collect()}) > 5
    assert len(same(spark, p)) == 60


def test_breaks_at_every_distance_from_a_border(spark, tmpdir_path, small_ranges):
    for shift in range(0, 61, 15):
        body = f'a,{"x" * shift}\nb,"one\n\n""two""\n,three"\nc,4\n'
        p = write(os.path.join(tmpdir_path, f"s{shift}.csv"), "id,v\n" + body * 3)
        assert len(same(spark, p)) == 9


def test_one_record_over_many_ranges(spark, tmpdir_path, small_ranges):
    long = "\n".join(f"line {i}, with ""quotes" for i in range(60))
    p = write(os.path.join(tmpdir_path, "long.csv"), f'id,v\na,1\nb,"{long}"\nc,3\n')
    rows = {r["id"]: r["v"] for r in read_delimited(spark, p, multiline=True).collect()}
    assert rows == {"a": "1", "b": long, "c": "3"}


def test_layouts(spark, tmpdir_path):
    at = lambda name, text: write(os.path.join(tmpdir_path, name), text)
    for text, how in [
        ('a,b\n1,2\n"x,y",""\n"say ""hi""",3\n', quoted.PLAIN),
        ('a,b\n1,"2\n3"\n', quoted.BROKEN),
        ('a,b\r\n1,"2\r\n3"\r\n', quoted.BROKEN),
        ('a,b\n1,"2"\r\n', quoted.PLAIN),
        ('a,b\npizza 12",5\npie,6\n', quoted.IRREGULAR),
        ('a,b\npizza 12",5\npie 9",6\n', quoted.IRREGULAR),
        ('a,b\n5" x 6" board,5\n', quoted.IRREGULAR),
        ('a,b\n"never closed,5\nc,6\n', quoted.IRREGULAR),
    ]:
        assert quoted.layout(spark, at(f"{abs(hash(text))}.csv", text), ",") == how, text


def test_irregular_files_keep_the_multiline_readers_rows(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "inch.csv"), 'id,v\npizza 12",5\n"two\nlines",6\n')
    assert same(spark, p) == [('pizza 12"', "5"), ("two\nlines", "6")]


def test_several_files_and_malformed_rows(spark, tmpdir_path, small_ranges):
    d = os.path.join(tmpdir_path, "feed")
    os.mkdir(d)
    write(os.path.join(d, "1.csv"), 'id|v\na|"x\ny"\nb|2|extra\n')
    write(os.path.join(d, "2.csv"), 'id|v\nc|"p|\nq"\n\n')
    rows = read_delimited(spark, d, multiline=True, keep_malformed=True, source_file=True).collect()
    got = {r["id"]: (r["v"], r["_corrupt_record"], os.path.basename(r["source_file"])) for r in rows}
    assert got == {"a": ("x\ny", None, "1.csv"), "b": ("2", "b|2|extra", "1.csv"), "c": ("p|\nq", None, "2.csv")}


def test_plain_files_need_no_shuffle(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "plain.csv"), 'id,v\n' + 'a,"b,c"\n' * 20)
    plan = read_delimited(spark, p, multiline=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "multiLine" not in plan
