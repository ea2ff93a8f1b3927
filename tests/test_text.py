"""Text files that Spark splits give the rows that parsing them whole gives."""

import numpy as np
import pytest

from curvelake.sources import readers

CONTENT = [("a", "float"), ("b", "int")]


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def files(folder, head="", sep=";"):
    """Two files of many blocks, with blank lines, comments, and line ends of several kinds; names that need quoting."""
    rng = np.random.default_rng(1)
    out = []
    for name, ends in (("a b+%41.csv", ["\n"]), ("c.csv", ["\r\n", "\n", "\n\n", "\x0b", " "])):
        lines = [f"{rng.normal():.6f}{sep}{i}" if i % 17 else f"nan{sep}{i}" for i in range(400)]
        text = head + "".join(x + ends[i % len(ends)] for i, x in enumerate(lines))
        (folder / name).write_bytes(text.encode())
        out.append(str(folder / name))
    return out


@pytest.mark.parametrize(
    "spec,head",
    [
        ({"format": "csv", "columns": ["a", "b"], "delimiter": ";"}, "\n\nx;y\n"), ({"format": "csv", "delimiter": ";"}, "a;b\n"),
        ({"format": "csv", "columns": ["a", "b"], "delimiter": ";", "header": False}, ""), ({"format": "csv", "columns": ["a", "b"], "delimiter": ";", "skip_rows": 90}, "\n\n" * 44 + "x;y\n"),
        ({"format": "csv", "columns": ["a", "b"], "delimiter": ";", "max_rows": 111}, "x;y\n"), ({"format": "text", "columns": ["a", "b"], "delimiter": ";"}, "# a b\n# c\n"),
    ],
)
def test_blocks_give_the_rows_of_whole_files(spark, tmp_path, small_blocks, spec, head):
    paths = files(tmp_path, head)
    df = readers.read_files(spark, paths, spec, CONTENT)
    assert readers.by_file(spec) or df.rdd.getNumPartitions() > 10
    got = {}
    for r in df.orderBy("__path", "__row").collect():
        got.setdefault(r["__path"].rpartition("/")[2], []).append((r.a, r.b, r["__row"]))
    assert len(got) == 2
    for p in paths:
        with open(p, "rb") as f:
            want = readers.parse_text(f.read(), spec, p)
        rows = got[p.rpartition("/")[2]]
        assert [r[:2] for r in rows] == [(None if a is None else float(a), int(b)) for a, b in zip(want["a"], want["b"], strict=True)]
        assert len({r[2] for r in rows}) == len(rows)


def test_a_header_behind_the_first_block_is_an_error(spark, tmp_path, small_blocks):
    paths = files(tmp_path, " " * 2000 + "\n7;8\n")
    with pytest.raises(Exception, match="first block holds no header"):
        readers.read_files(spark, paths, {"format": "csv", "columns": ["a", "b"], "delimiter": ";"}, CONTENT).collect()


def test_lines_are_parsed_by_batches(spark, tmp_path):
    """No step holds a file: batches that come out are no larger than those that went in."""
    (tmp_path / "long.csv").write_text("a;b\n" + "".join(f"{i};{i}\n" for i in range(25000)))
    df = readers.read_lines(spark, [str(tmp_path / "long.csv")], {"format": "csv", "columns": ["a", "b"], "delimiter": ";"})
    sizes = [len(got["a"]) for _, _, got in readers.parse_lines(iter(df.toArrow().to_batches(max_chunksize=1000)), {"format": "csv", "columns": ["a", "b"], "delimiter": ";"})]
    assert max(sizes) <= 1000 and sum(sizes) == 25000
