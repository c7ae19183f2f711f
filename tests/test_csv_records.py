"""Quoted multi-line CSV read by blocks, against Spark's own multiLine reader, cut at every place."""

import csv
import io
import os
import random

import pytest

from spanfold.sources import span_files as SF


def whole(spark, path):
    df = spark.read.schema(SF.SPAN_CSV_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return sorted(((r["doc_id"], r["spans"], r["text"]) for r in df.collect()), key=str)


def by_blocks(spark, path):
    from pyspark.sql import functions as F

    parts = SF.csv_records(spark, path)
    row = F.from_csv("record", "doc_id long, spans string, text string", {"escape": '"', "multiLine": "true"})
    return sorted(((r["doc_id"], r["spans"], r["text"]) for r in parts.select(row.alias("r")).select("r.*").collect()), key=str)


@pytest.fixture
def cut_small(spark):
    """Sets the size of a block; the planner's other limits don't interfere."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], str(size))

    yield set_to
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def write(path, rows, end="\n", last=True):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    w.writerow(["doc_id", "spans", "text"])
    w.writerows(rows)
    body = out.getvalue()
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(body if last else body[: -len(end)])
    return len(body.encode())


ROWS = [(1, "[1, 2]", 'say "yes"\nor\n\nno'), (2, "[]", "plain"), (3, "[5]", ""), (4, "[]", '"'), (5, "[7, 8]", "é\n日,本\n"), (6, "[]", "\n\n\n\n\n\n\n\n\n\n"), (7, "[0]", "a,b"), (8, "[]", '""\n""')]


def test_equal_at_every_cut(spark, cut_small, tmp_path):
    path = str(tmp_path / "posts.csv")
    size = write(path, ROWS)
    want = whole(spark, path)
    assert len(want) == len(ROWS)
    for block in [*range(1, 40, 3), 50, 77, size - 1, size, 10 * size]:
        cut_small(block)
        assert by_blocks(spark, path) == want, block
    cut_small(20)
    from spanfold.sources.csv_records import _lines

    assert _lines(spark, path).rdd.getNumPartitions() > 5


@pytest.mark.parametrize("end, last", [("\r\n", True), ("\n", False), ("\r\n", False)])
def test_line_ends_inside_quotes_stay_as_they_are(spark, cut_small, tmp_path, end, last):
    """Offsets count characters, so nothing inside quotes may change (the multiLine reader turns CR LF into LF in such files)."""
    path = str(tmp_path / "posts.csv")
    write(path, [(1, "[]", "x\r\ny"), (2, "[]", "z\rz"), (3, "[]", "end")], end, last)
    with open(path, newline="") as f:
        want = [(int(a), b, c) for a, b, c in list(csv.reader(f))[1:]]
    for block in (3, 11, 1000):
        cut_small(block)
        assert by_blocks(spark, path) == want


def test_several_random_files(spark, cut_small, tmp_path):
    rng = random.Random(8)
    os.mkdir(tmp_path / "in")
    n = 0
    for k in range(4):
        rows = []
        for _ in range(rng.choice([0, 3, 40])):
            n += 1
            rows.append((n, str([rng.randrange(9)]), "".join(rng.choice(['"', "\n", ",", "word ", "é", " "]) for _ in range(rng.randrange(30)))))
        write(tmp_path / "in" / f"part-{k}.csv", rows)
    path = str(tmp_path / "in")
    want = whole(spark, path)
    assert len(want) == n
    for block in (7, 64, 500, 1 << 20):
        cut_small(block)
        assert by_blocks(spark, path) == want


def test_long_header_open_quote_and_nothing(spark, cut_small, tmp_path):
    path = str(tmp_path / "posts.csv")
    with open(path, "w", newline="") as f:
        f.write('doc_id,spans,"text\nof\nthe\npost"\n1,[],"a\nb"\n2,[],"open\nto the end')
    for block in (2, 9, 1000):
        cut_small(block)
        got = by_blocks(spark, path)
        assert [r[0] for r in got] == [1, 2] and got[0] == (1, "[]", "a\nb")
    empty = str(tmp_path / "empty.csv")
    open(empty, "w").close()
    assert by_blocks(spark, empty) == [] and SF.read_span_csv(spark, empty).count() == 0
