"""Text sources: halo lists, memberships, substructure, tree links, sidecar files.

In memberships, substructure and links a line's meaning depends on the lines before it: a header says how many lines are its own.
Such files are read in pieces of any size (``read_members``, ``read_substructure``, ``read_links``): lines are numbered, each
line that could be a header points to where the next would be, what the first header leads to is a header, and the other
lines find theirs by number.  The format ``halo_text`` reads each file in one task, for small files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from haloforge.operators.links import follow
from haloforge.operators.runs import run_members
from haloforge.operators.transform import rank_from_zero
from haloforge.sources.files import lines
from haloforge.work import materialize

#: Columns of a halo list, by place.
_HALO_COLUMNS = [(0, "halo_id", "bigint"), (1, "host_id", "bigint"), (2, "n_sub", "int"), (3, "mass", "double"), (4, "npart", "bigint"), (5, "x", "double"), (6, "y", "double"), (7, "z", "double"), (8, "vx", "double"), (9, "vy", "double"), (10, "vz", "double"), (11, "r200", "double"), (15, "com_offset", "double"), (16, "vmax", "double")]


def halo_list(spark: SparkSession, path: str) -> DataFrame:
    """halos of white-space tables with # comments; row_id orders them as the files do, by their numbers or names, and the lines in
    them do, however Spark deals out the files."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # A block's lines are numbered in a row; blocks are few, so their first numbers meet in one place.
    blocks = text.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    upto = F.sum("n").over(Window.orderBy(F.length("file"), "file", "block"))
    placed = text.join(blocks.select("file", "block", "from", (upto - F.col("n")).alias("before")), ["file", "block"])
    numbered = placed.select("value", (F.col("at") - F.col("from") + F.col("before")).alias("row_id"))
    parts = numbered.where("trim(value) <> '' and not startswith(trim(value), '#')").select("row_id", F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.select("row_id", *[F.get("p", k).cast(kind).alias(name) for k, name, kind in _HALO_COLUMNS])


def _numbered(spark: SparkSession, path: str | list[str], skip: int = 0) -> DataFrame:
    """file (a number, by the files' order), no, parts: the words of lines that aren't blank, numbered from 0 on in each file after ``skip`` lines."""
    paths = path.split(",") if isinstance(path, str) else path
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    text = materialize(text, "lines")
    # A block's lines are numbered in a row; a row for each block meets in one place.
    blocks = text.groupBy("name", "block").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    by_file = Window.partitionBy("name").orderBy("block")
    blocks = blocks.select("name", "block", "from", (F.sum("n").over(by_file) - F.col("n")).alias("before"), (F.dense_rank().over(Window.orderBy(F.length("name"), "name")) - 1).alias("file"))
    placed = text.join(blocks, ["name", "block"]).select("file", (F.col("at") - F.col("from") + F.col("before")).alias("line"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("parts"))
    kept = placed.where((F.col("line") >= skip) & (F.get("parts", 0) != ""))
    ranked = rank_from_zero(kept.withColumn("key", F.shiftleft(F.col("file").cast("long"), 44) + F.col("line")), "key", "rank")
    first = ranked.groupBy("file").agg(F.min("rank").alias("first"))
    return materialize(ranked.join(F.broadcast(first), "file").select("file", (F.col("rank") - F.col("first")).alias("no"), "parts"), "lines")  # a row a file


def _number(k: int) -> Column:
    return F.get("parts", k).try_cast("long")


def _headers(lines: DataFrame, jump: Column, first: int, most: DataFrame | None = None) -> DataFrame:
    """file, no, rank, parts of the lines that the first header leads to.  jump: how many lines on the next header would be, where the line could be one;
    most (file, n): no more of each file than that."""
    ends = lines.groupBy("file").agg((F.max("no") + 1).alias("end"))
    key = lambda no: F.struct("file", no.alias("no"))
    could = lines.join(F.broadcast(ends), "file").withColumn("__to", F.col("no") + jump).where(F.col("__to").isNotNull() & (F.col("__to") > F.col("no")))
    # What would need more lines than the file has is no header, and what leads there isn't either, unless the file is cut off.
    links = could.where(F.col("__to") <= F.col("end")).select(key(F.col("no")).alias("node"), F.when(F.col("__to") < F.col("end"), key(F.col("__to"))).alias("to"))
    roots = lines.where(F.col("no") == first).select(key(F.col("no")).alias("node"))
    found = follow(links, roots).select("node.file", "node.no", F.col("depth").alias("rank"))
    if most is not None:
        found = found.join(F.broadcast(most), "file").where(F.col("rank") < F.col("n")).drop("n")
    return found.join(lines, ["file", "no"])


def _with_heads(lines: DataFrame, heads: DataFrame, *columns: Column) -> DataFrame:
    """file, no, parts, member_rank and the heads' columns, of the lines that follow each header and are its own."""
    runs = heads.select("file", (F.col("no") + 1).alias("start"), *columns)
    return run_members(runs, lines.select("file", F.col("no").alias("position"), "parts"), ["file"])


def read_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """halo_rank, halo_id, member_rank, pid, ptype: a count of groups, then for each a line ``n haloid`` and n lines ``pid ptype``."""
    lines = _numbered(spark, path)
    most = lines.where("no = 0").select("file", _number(0).alias("n"))
    # The count's own line leads nowhere; a header has two numbers.
    jump = F.when((F.col("no") > 0) & (F.size("parts") > 1) & (_number(0) >= 0), _number(0) + 1)
    heads = materialize(_headers(lines, jump, 1, most), "headers")
    n = _number(0)
    # The path of headers ends where one needs more lines than there are.
    told = heads.groupBy("file").agg(F.count("*").alias("there"), F.max(F.col("no") + n + 1).alias("after"))
    told = most.join(told, "file", "left").join(lines.groupBy("file").agg(F.max("no").alias("last")), "file")
    if not told.where("coalesce(there, 0) < n and coalesce(after, 1) <= last").isEmpty():
        raise ValueError("a file ends within a group")
    found = _with_heads(lines, heads, n.alias("length"), F.col("rank").alias("halo_rank"), _number(1).alias("halo_id"))
    return found.select("halo_rank", "halo_id", "member_rank", F.get("parts", 0).cast("long").alias("pid"), F.get("parts", 1).cast("int").alias("ptype"))


def read_substructure(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """host_id, sub_id: pairs of lines ``host n`` and ``id id ...``; without substructures the second is blank or missing."""
    lines = _numbered(spark, path)
    jump = F.when((F.size("parts") > 1) & (_number(1) >= 0), F.when(_number(1) > 0, 2).otherwise(1))
    # The last host may lack its line.
    ends = lines.groupBy("file").agg((F.max("no") + 1).alias("end"))
    lines_and_end = lines.union(ends.selectExpr("file", "end as no", "cast(array() as array<string>) as parts"))
    heads = _headers(lines_and_end, jump, 0)
    found = _with_heads(lines, heads.where(_number(1) > 0), F.lit(1).alias("length"), _number(0).alias("host_id"), _number(1).alias("n"))
    return found.select("host_id", F.explode(F.slice("parts", F.lit(1), F.col("n").cast("int"))).alias("sub_id")).select("host_id", F.col("sub_id").cast("long").alias("sub_id"))


def read_links(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """desc_id, prog_rank, prog_id: three lines of head, then ``desc n`` and n progenitors, until END."""
    lines = _numbered(spark, path, skip=3)
    jump = F.when((F.size("parts") > 1) & (F.get("parts", 0) != "END") & (_number(1) >= 0), _number(1) + 1)
    heads = materialize(_headers(lines, jump, 0), "headers")
    # The path of headers ends at END, at the file's end, or where one needs more lines than there are.
    after = heads.groupBy("file").agg(F.max(F.col("no") + _number(1) + 1).alias("no")).join(lines, ["file", "no"])
    if not after.where(F.get("parts", 0) != "END").isEmpty():
        raise ValueError("a file ends within a descendant's progenitors")
    found = _with_heads(lines, heads, _number(1).alias("length"), _number(0).alias("desc_id"))
    return found.select("desc_id", F.col("member_rank").cast("int").alias("prog_rank"), F.get("parts", 0).cast("long").alias("prog_id"))


class _SequentialReader(DataSourceReader):
    """Where a line means depends on the lines before it, so a file is read by one task, in batches; many files are many tasks' work."""

    def __init__(self, path: str, schema, parse: Callable[[Iterator[str]], Iterator[tuple]]):
        self.path, self.names, self.parse = path, schema.names, parse
        self.kinds = [{"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self.parse(lines(part.value)):
            held.append(row)
            if len(held) == 65_536:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), self.kinds, strict=True)], self.names)


def parse_members(text: Iterator[str]) -> Iterator[tuple]:
    """(halo_rank, halo_id, member_rank, pid, ptype): a count of groups, then for each a line ``n haloid`` and n lines ``pid ptype``."""
    rows = (x.split() for x in text if x.strip())
    for rank in range(int(next(rows, ["0"])[0])):
        head = next(rows, None)
        if head is None:
            return
        for k in range(int(head[0])):
            pid, ptype = next(rows)[:2]
            yield rank, int(head[1]), k, int(pid), int(ptype)


def parse_substructure(text: Iterator[str]) -> Iterator[tuple]:
    """(host_id, sub_id): pairs of lines ``host n`` and ``id id ...``."""
    rows = (x.split() for x in text if x.strip())
    for head in rows:
        n = int(head[1])
        if n:  # without substructures, the second line is blank or missing
            for sub in next(rows, [])[:n]:
                yield int(head[0]), int(sub)


def parse_links(text: Iterator[str]) -> Iterator[tuple]:
    """(desc_id, prog_rank, prog_id): three lines of head, then ``desc n`` and n progenitors, until END."""
    rows = iter(text)
    for _ in range(3):
        next(rows, None)
    for line in rows:
        parts = line.split()
        if not parts:
            continue
        if parts[0] == "END":
            return
        for rank in range(int(parts[1])):
            yield int(parts[0]), rank, int(next(rows).split()[0])


_KINDS = {
    "members": ("halo_rank bigint, halo_id bigint, member_rank bigint, pid bigint, ptype int", parse_members),
    "substructure": ("host_id bigint, sub_id bigint", parse_substructure),
    "links": ("desc_id bigint, prog_rank int, prog_id bigint", parse_links),
}


class HaloTextSource(DataSource):
    """``spark.read.format("halo_text").option("kind", "members" | "substructure" | "links").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "halo_text"

    def _kind(self):
        kind = self.options.get("kind", "")
        if kind not in _KINDS:
            raise ValueError(f"kind is one of {', '.join(_KINDS)}")
        return _KINDS[kind]

    def schema(self) -> str:
        return self._kind()[0]

    def reader(self, schema) -> DataSourceReader:
        return _SequentialReader(self.options["path"], schema, self._kind()[1])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HaloTextSource)


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value, type of ``key : value # type`` and ``key=value # type`` lines; an empty value or type is ''."""
    pattern = r"^\s*([^:=#\s][^:=#]*?)\s*[:=]\s*(.*?)\s*(?:#\s*(\S*)\s*)?$"
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.col("value").rlike(pattern))
    return rows.select("file", *[F.regexp_extract("value", pattern, k).alias(n) for k, n in ((1, "key"), (2, "value"), (3, "type"))])
