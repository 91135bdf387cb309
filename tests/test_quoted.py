import random

import numpy as np
import pytest

from tabsight.sources import csv, quoted


@pytest.fixture
def splits(spark):
    """Set the size of input splits for a test."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in keep.items():
        spark.conf.set(k, v)


def odd_field(rng):
    k = rng.random()
    if k < 0.3:
        return "".join(rng.choice("abc xyz09") for _ in range(rng.randint(0, 6)))
    if k < 0.45:
        return rng.choice(['5" pipe', 'a"b"c', 'it"', 'x""y', '"ab" tail'])
    return '"' + "".join(rng.choice(["a", "b,", '""', "\n", "\r\n", "\n\n", " ", "é", ","]) for _ in range(rng.randint(0, 12))) + '"'


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((x is None, x or "") for x in r))


@pytest.mark.parametrize("seed,end,size", [(0, "\n", 90), (1, "\r\n", 90), (2, "\n", 400), (3, "\r\n", 3000)])
def test_equals_the_reader_of_whole_files(spark, splits, tmp_path, seed, end, size):
    rng = random.Random(seed)
    paths = []
    for name in ("a", "b"):
        text = "id,a,b,c" + end + "".join(",".join([f"{name}{i}", *(odd_field(rng) for _ in range(3))]) + end for i in range(40))
        paths.append(tmp_path / f"{name}.csv")
        paths[-1].write_bytes((text if seed % 2 else text[: -len(end)]).encode())
    want = rows_of(spark.read.csv([str(p) for p in paths], header=True, escape='"', multiLine=True))
    splits(size)
    assert rows_of(quoted.scan_quoted(spark, [str(p) for p in paths])) == want
    if size < 100:
        assert quoted.split_states(spark, [str(paths[0])]).count() > 10


def test_a_record_over_many_splits(spark, splits, tmp_path):
    long = "line\n" * 500
    path = tmp_path / "x.csv"
    path.write_text(f'id,"he\nader"\n1,"{long}"\n2,"a"\n3,"{long}x"')
    splits(100)
    states = quoted.split_states(spark, [str(path)])
    assert states.count() > 40 and states.filter("state").count() > 35
    got = quoted.scan_quoted(spark, [str(path)])
    assert got.columns == ["id", "he\nader"] and rows_of(got) == [("1", long), ("2", "a"), ("3", long + "x")]


def test_states_of_lines():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 12))
        outside, inside, start = rng.random(n) < 0.5, rng.random(n) < 0.5, bool(rng.random() < 0.5)
        want, state = [], start
        for o, i in zip(outside, inside):
            state = bool(i if state else o)
            want.append(state)
        assert quoted.after_lines(outside, inside, start).tolist() == want


def test_preflight_finds_extra_fields_between_quoted_breaks(spark, splits, tmp_path):
    for name, row in (("good", '2,"c\nd"'), ("wide", '2,"c\nd",extra')):
        (tmp_path / f"{name}.csv").write_text(f'id,text\n1,"a,\n""b"""\n{row}\n3,e\n')
    splits(12)
    got = {r["file"].rsplit("/", 1)[1]: r for r in csv.preflight(spark, str(tmp_path)).collect()}
    assert got["good.csv"]["errors"] == [] and got["wide.csv"]["errors"] == [csv.WIDE_ROW]
    assert [got[f]["data_rows"] for f in ("good.csv", "wide.csv")] == [3, 3] and got["good.csv"]["columns"] == 2


def test_line_ends_of_carriage_returns_alone(spark, tmp_path):
    path = tmp_path / "mac.csv"
    path.write_bytes(b'id,text\r1,"a\rb"\r2,c\r')
    want = rows_of(spark.read.csv(str(path), header=True, escape='"', multiLine=True))
    assert rows_of(csv.read_csv(spark, str(path))) == want and len(want) == 2


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"te\nxt"\n')
    assert csv.read_csv(spark, str(tmp_path)).collect() == []
