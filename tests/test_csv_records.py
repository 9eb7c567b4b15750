"""CSV cells with line breaks, read in splits of a few bytes, against Python's reader."""

import csv
import io
import random

import pytest

from tabwright.sources import tables
from tabwright.sources.csv_records import csv_records, header_names, text_lines

PIECES = ["a", "5\" disk", ",", "\n", '"', '""', "\n\n", "x,y", "\r\n", '",', ',"', " ", '"\n', "ü"]


@pytest.fixture
def splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield size
    for k, v in kept.items():
        spark.conf.set(k, v)


def written(rows, end):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed,size,end", [(1, 11, "\n"), (2, 64, "\r\n"), (3, 1000, "\n"), (4, 5, "\n")])
def test_equals_a_reader_of_whole_files(spark, tmp_path, splits, seed, size, end):
    rng = random.Random(seed)
    rows = []
    for f in range(2):
        mine = [(f"k{seed}-{f}-{i}", "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 7))) + "z", f"t{i}") for i in range(40)]
        mine[5] = (mine[5][0], "long\n" * 60 + 'end "', "t")
        (tmp_path / f"{f}.csv").write_text(written([("key", "free text", "tail")] + mine, end), newline="")
        rows += mine
    splits(size)
    lines = text_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 3 or size == 1000
    got = tables.scan_csv(spark, str(tmp_path))
    assert got.columns == ["key", "free text", "tail"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)


def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_text('k,v\n1,5" disk\n2,"b\n""c"""\n\n3,d"e"\n4,"","x\n' .replace('4,"","x', '4,""'))
    splits(7)
    got = tables.scan_csv(spark, str(tmp_path), "k int, v string")
    assert sorted((r["k"], r["v"] or "") for r in got.collect()) == [(1, '5" disk'), (2, 'b\n"c"'), (3, 'd"e"'), (4, "")]


def test_records_keep_their_order_and_an_open_cell_takes_the_rest(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_text('k,v\n1,"a\nb"\n2,c\n3,"open\n4,d\n5,e\n')
    splits(6)
    got = [r["record"] for r in csv_records(text_lines(spark, str(tmp_path))).orderBy("place").collect()]
    assert got == ["k,v", '1,"a\nb"', "2,c", '3,"open\n4,d\n5,e']


def test_a_row_of_another_width_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"a\nb"\n2,c,d\n')
    with pytest.raises(Exception):
        tables.scan_csv(spark, str(tmp_path)).collect()


def test_header_names():
    assert header_names('﻿a,"b\nc",,A') == ["a0", "b\nc", "_c2", "A3"]
