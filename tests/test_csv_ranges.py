"""Files cut into ranges against the reader that takes a file as a whole."""

import csv
import io
import random

import pytest

from gondola.sources import csv_ranges


@pytest.fixture
def small(spark):
    """Sessions whose file ranges are a few dozen bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(v)) for k, v in zip(kept, (n, 1))]
    for k, v in kept.items():
        spark.conf.set(k, v)


def whole(spark, path):
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed,size", [(1, 60), (2, 25), (3, 97), (4, 400)])
def test_generated_files(spark, tmp_path, small, seed, size):
    """Quotes, line ends and commas in cells, a byte order mark, short and blank rows."""
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "é", '"', "\n", ",", " ", "b", "xyz", ""]) for _ in range(rng.choice([0, 1, 3, 9, 60])))
    out = io.StringIO(newline="")
    end = "\r\n" if seed == 1 else "\n"  # the other reader takes the first line end for all
    write = csv.writer(out, lineterminator=end)
    write.writerow(["first", "second", "a \nthird" if seed == 3 else "third", "fourth"])
    for _ in range(40):
        write.writerow([cell() for _ in range(rng.choice([4, 4, 4, 2, 5]))])
        if rng.random() < 0.1:
            out.write(end)
    (tmp_path / "x.csv").write_text(("﻿" if seed > 2 else "") + out.getvalue(), encoding="utf-8", newline="")
    path = f"{tmp_path}/x.csv"
    expected = rows(whole(spark, path))
    small(size)
    found = csv_ranges.read_ranges(spark, path)
    assert found.columns == whole(spark, path).columns
    assert rows(found) == expected and len(expected) > 25
    assert csv_ranges._lines(spark, path).rdd.getNumPartitions() > 4


@pytest.mark.parametrize("text", ["", "a,b\n", "a,b", "a,b\n1,2", '"a","b"\n"1\n2",3\n', 'a,b\n"open,1\n2,3', "a,b\n\n\n1,2\n\n", '"a\nlong\nhead","b"\n1,2\n', 'a,b\n1,"' + "x\n" * 200 + 'y"\n3,4\n'])
def test_odd_files(spark, tmp_path, small, monkeypatch, text):
    (tmp_path / "x.csv").write_text(text, newline="")
    expected = rows(whole(spark, f"{tmp_path}/x.csv")) if text.count("\n") else []
    monkeypatch.setattr(csv_ranges, "PIECE", 4)
    small(17)
    assert rows(csv_ranges.read_ranges(spark, f"{tmp_path}/x.csv")) == expected


def test_quotes_inside_open_cells_are_text(spark, tmp_path, small):
    text = 'name,size\nscreen 5" wide,1\nb,"2"\n"c ""x""\n,d",3\ne"f,"4\n5"\n'
    (tmp_path / "x.csv").write_text(text, newline="")
    small(11)
    assert rows(csv_ranges.read_ranges(spark, f"{tmp_path}/x.csv")) == sorted(tuple(r.values()) for r in csv.DictReader(io.StringIO(text, newline="")))


def test_folders_and_many_ranges(spark, tmp_path, small, monkeypatch):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text('a,b\n"1\n",2\n3,4\n' * 1 + f'{i},"\n\n\n"\n', newline="")
    expected = rows(whole(spark, str(tmp_path)))
    small(9)
    monkeypatch.setattr(csv_ranges, "SENT_RANGES", 0)
    monkeypatch.setattr(csv_ranges, "PIECE", 2)
    assert rows(csv_ranges.read_ranges(spark, str(tmp_path))) == expected


def test_open_cells_by_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice('a,""') for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            state = "in" if inside else "start"
            for c in line:
                if state == "start":
                    state = "in" if c == '"' else "start" if c == "," else "text"
                elif state == "text":
                    state = "start" if c == "," else "text"
                elif state == "in":
                    state = "quote" if c == '"' else "in"
                else:
                    state = "in" if c == '"' else "start" if c == "," else "text"
            assert csv_ranges.open_after(line, inside) == (state == "in"), (line, inside)


def test_records_are_parsed_once(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,,"x\n2"\n3,4\n')
    found = csv_ranges.read_ranges(spark, f"{tmp_path}/x.csv")
    assert rows(found) == [("1", None, "x\n2"), ("3", "4", None)]
    # once where a range holds the record, once where it reaches over borders; not for each column
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 2


def test_whole_blocks_of_lines_as_line_by_line():
    import pyarrow as pa

    rng = random.Random(2)
    lines = ["".join(rng.choice('a,""é') for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    after = csv_ranges._after(pa.array(lines))
    for begin in (False, True):
        assert after[int(begin)].tolist() == [csv_ranges.open_after(x, begin) for x in lines]
        inside, expected = begin, []
        for x in lines:
            inside = csv_ranges.open_after(x, inside)
            expected.append(inside)
        assert csv_ranges._states(*after, begin).tolist() == expected
