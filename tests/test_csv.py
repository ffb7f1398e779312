"""CSV libraries in blocks of any size against Python's reader."""

import csv
import io
import random

import pytest

from assaykit.sources import readers

COLUMNS = ["id", "smiles", "note"]


def written(rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerows(rows)
    return out.getvalue()


def expected(texts):
    out, n = [], 0
    for text in texts:
        for row in csv.DictReader(io.StringIO(text, newline="")):
            smiles, name = (row.get("smiles") or "").strip(" "), (row.get("id") or "").strip(" ")
            if smiles:
                out.append((n, name or str(n), smiles))
            n += 1
    return out


@pytest.fixture
def blocks_of(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def set_(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1")

    yield set_
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [7, 40, 300, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_with_line_breaks_in_quotes(spark, tmp_path, blocks_of, size, end):
    rng = random.Random(size)
    note = lambda: rng.choice(["", "plain", 'say ""x', "two\nlines", "\n\n", 'a "q" b\n"', "x,y", '"', "\n"])
    texts = []
    for k in range(3):
        rows = [[f"n{k}-{i}" if rng.random() < 0.7 else "", rng.choice(["CCO", "C(C)C", "  ", "c1ccccc1", "C\nC"]), note()] for i in range(14)]
        text = written([COLUMNS, *rows], end)
        texts.append(text if k else text.replace(end + "n0-5", end + end + "n0-5", 1))  # a blank line between records
        (tmp_path / f"part{k}.csv").write_bytes(texts[-1].encode())
    blocks_of(size)
    got = sorted(map(tuple, readers.csv(spark, str(tmp_path), "smiles", "id").collect()))
    assert got == expected(texts)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, blocks_of):
    rows = [[f"n{i}", "CCO", "x" * 30 + ("\n" if i % 10 == 0 else "")] for i in range(4000)]
    (tmp_path / "big.csv").write_text(written([COLUMNS, *rows]))
    blocks_of(20_000)
    df = readers._records(spark, str(tmp_path / "big.csv"))
    assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() >= 8
    assert df.where("NOT header").count() == 4000 and df.where("header").count() == 1
    got = readers.csv(spark, str(tmp_path / "big.csv"), "smiles", "id").orderBy("ord").collect()
    assert [(r.ord, r.identifier) for r in got] == [(i, f"n{i}") for i in range(4000)]


def test_broken_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,structure\nA1,CCO\n")
    with pytest.raises(ValueError, match="smiles"):
        readers.csv(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_bytes(b"smiles\nCC\xff\n")
    with pytest.raises(Exception, match="UTF-8"):
        readers.csv(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.csv").write_text("smiles,id\nCCO\nCC,x,more\n")
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "c.csv"), "smiles", "id").collect())) == [(0, "0", "CCO"), (1, "x", "CC")]
    (tmp_path / "d.csv").write_text("smiles\n")
    assert readers.csv(spark, str(tmp_path / "d.csv")).collect() == []
