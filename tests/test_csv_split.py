"""CSV read by blocks against Python's reader and Spark's multiLine reader."""

import csv
import io
import os
import random
import tempfile

import pytest

from shoprank.sources import csv_split
from shoprank.sources.catalog import read_catalog_csv
from shoprank.sources.csv_split import after_line, csv_records, fields_of, read_csv, with_place_ordinal


def folder_of(files):
    d = tempfile.mkdtemp(prefix="shoprank-csv-split-")
    for name, text in files.items():
        with open(os.path.join(d, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return d


@pytest.fixture
def small_blocks(spark):
    """Blocks of 200 bytes, so that records cross many of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


PARTS = ["a", "word", "", "é", 'say "hi"', "one\ntwo", "x,y", "\n", '"', '""', "tail\n", "line\n\nline,\n\"q\"", "1.5", 'five" tube', "long " * 40, "\n" * 30]


def written(rnd, rows, cols=3, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    data = [[rnd.choice(PARTS) for _ in range(cols - 1)] + [str(i)] for i in range(rows)]
    w.writerow([f"c{i}" for i in range(cols)])
    w.writerows(data)
    return out.getvalue(), data


def test_records_equal_pythons(spark, small_blocks):
    rnd = random.Random(7)
    made = {f"f{i}.csv": written(rnd, n, end=end) for i, (n, end) in enumerate([(60, "\n"), (1, "\n"), (40, "\r\n"), (0, "\n")])}
    path = folder_of({k: t for k, (t, _) in made.items()})
    records = csv_records(spark, path)
    assert records.rdd.getNumPartitions() >= 1 and spark.read.text(path).rdd.getNumPartitions() > 20
    got = {}
    for r in records.collect():
        assert r.reason is None
        got.setdefault(os.path.basename(r.file), []).append((r.begins, r.place, r.fields))
    for name, (text, _) in made.items():
        want = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
        have = [f for *_, f in sorted(got[name], key=lambda x: x[:2])]
        assert have == want


def test_shuffled_lines_keep_their_order(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(csv_split, "BROADCAST_BYTES", 0)
    text, data = written(random.Random(3), 50)
    rows, rejects = read_csv(spark, folder_of({"a.csv": text}))
    got = [(r.c0, r.c1, r.c2) for r in with_place_ordinal(rows, "no").orderBy("no").collect()]
    assert got == [tuple(x or None for x in row) for row in data] and rejects.count() == 0


def test_rejects_and_headers(spark, small_blocks):
    files = {"a.csv": '﻿id,name\n1,x\n\n2,"y\nz",extra\n3\n4,"w ""q"""\r\n,\n5,"open\nuntil,the\nend' + "\nmore" * 100,
             "b.csv": "name,other,id\nn,o,7\n"}
    rows, rejects = read_csv(spark, folder_of(files))
    got = sorted((str(r.id), str(r["name"]), str(r.other)) for r in rows.collect())
    assert got == sorted([("1", "x", "None"), ("4", 'w "q"', "None"), ("None", "None", "None"), ("7", "n", "o")])
    assert sorted((r.reason, r.text[:6]) for r in rejects.collect()) == [("fields", '2,"y\nz'), ("fields", "3"), ("quote", '5,"ope')]


def test_line_states():
    assert not after_line("a,b", False) and after_line("a,b", True)
    assert after_line('a,"b', False) and not after_line('b",c', True) and not after_line('a,"b""c"', False)
    assert after_line('x""', True) and not after_line('x"""', True) and not after_line('five" tube,"x"', False)
    assert after_line('"', False) and not after_line('"', True) and after_line('a",b,"c', True) and not after_line('""', False)
    assert fields_of('a,"b""c",') == ["a", 'b"c', ""] and fields_of("") == [""] and fields_of('"x') is None and fields_of('"a"b,c') == ["ab", "c"]


def test_catalog_equals_spark_reader(spark, small_blocks):
    rnd = random.Random(5)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["junk", "title", "store", "price", "average_rating", "image"])
    for i in range(80):
        w.writerow([i, f"t{i} " + rnd.choice(PARTS).strip() + "x", rnd.choice(["s", "a, b"]), rnd.choice(["1.5", "", "N/A", "bad", "9"]), "4.5", f"http://x/{i}"])
    path = folder_of({"c.csv": out.getvalue()})
    for a, b in zip(read_catalog_csv(spark, path, split=True), read_catalog_csv(spark, path)):
        cols = [c for c in ("product_id", "title", "store", "price", "average_rating", "image", "reason") if c in b.columns]
        assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect())) and a.count() > 5
    broken = folder_of({"c.csv": out.getvalue() + 'x,y\n1,"open\n'})
    _, rejects = read_catalog_csv(spark, broken, split=True)
    assert {r.reason for r in rejects.collect()} == {"price", "fields", "quote"}
