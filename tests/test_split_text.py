"""Text catalogues read in pieces of any size, against the parsers that read line after line."""

import random

import pytest

from haloforge.sources import text


def sequential(parse, *paths):
    return sorted(row for p in paths for row in parse(iter(p.read_text().splitlines())))


@pytest.fixture(params=[64, 999, 1 << 27])
def pieces(spark, request):
    """Bytes of a piece: a few lines, some groups, the whole file."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "1")
    yield request.param
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def members_file(path, seed, n):
    """Small ids, so that nearly every line could be a header; empty groups and blank lines."""
    r = random.Random(seed)
    out = [str(n)]
    for k in range(n):
        size = r.choice([0, 1, 2, 9])
        out += [f"{size}\t{1000 * seed + k}", *(f"{r.randrange(6)} {r.randrange(6)}" for _ in range(size))] + [""] * (r.random() < 0.2)
    path.write_text("\n".join(out) + "\n")
    return path


def test_members(spark, tmp_path, pieces):
    a, b = members_file(tmp_path / "a.txt", 1, 40), members_file(tmp_path / "b.txt", 2, 25)
    found = text.read_members(spark, [str(a), str(b)])
    assert sorted(map(tuple, found.collect())) == sequential(text.parse_members, a, b)


def test_substructure(spark, tmp_path, pieces):
    r = random.Random(3)
    out = []
    for k in range(60):
        subs = [r.randrange(4) for _ in range(r.choice([0, 1, 5]))]
        out += [f"{k} {len(subs)}", " ".join(map(str, subs))] if subs else [f"{k} 0", *([""] * r.randrange(2))]
    path = tmp_path / "s.txt"
    path.write_text("\n".join([*out, "99 1", "7"]))
    assert sorted(map(tuple, text.read_substructure(spark, str(path)).collect())) == sequential(text.parse_substructure, path)
    path.write_text("\n".join([*out, "98 2", "7 8", "99 2"]))  # the last host lacks its line
    assert sorted(map(tuple, text.read_substructure(spark, str(path)).collect())) == sequential(text.parse_substructure, path)


def test_links(spark, tmp_path, pieces):
    r = random.Random(4)
    out = ["head", "", "3 2"]
    for k in range(50):
        n = r.choice([0, 1, 4])
        out += [f"{k} {n}", *(f"{r.randrange(5)} {r.randrange(3)}" for _ in range(n))]
    path = tmp_path / "l.txt"
    path.write_text("\n".join([*out, "END", "5 1", "6"]))
    assert sorted(map(tuple, text.read_links(spark, str(path)).collect())) == sequential(text.parse_links, path)


def test_files_that_are_cut_off(spark, tmp_path):
    a = tmp_path / "a.txt"
    a.write_text("2\n2 77\n1 1\n2 1\n3 78\n4 0\n")
    with pytest.raises(ValueError, match="ends within"):
        text.read_members(spark, str(a)).count()
    a.write_text("x\nx\nx\n1 1\n2\n3 4\n9\n")
    with pytest.raises(ValueError, match="ends within"):
        text.read_links(spark, str(a)).count()
    a.write_text("0\n")
    assert text.read_members(spark, str(a)).count() == 0
