"""Binary particle snapshots of both layouts, as a Spark data source: ``spark.read.format("snapshot")``.

Options: path; format (SNAP1, SNAP2 and their synonyms); pids_type (uint32, uint64); extra_blocks (of POT, Z, AGE, SFR;
SNAP2 only); columns (those to read, e.g. x,y,z); hires_only; rows_per_task.  A task reads one range of rows of one
type of one file; only the driver reads headers.  A filter on ptype leaves whole types unread.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from haloforge.cosmology import GAS, LOW_RES_TYPES, STAR, SimHeader
from haloforge.sources.files import all_parts, numbered, open_file

SCHEMA = "row_id bigint, pid bigint, ptype int, x double, y double, z double, vx double, vy double, vz double, mass double, potential double, u double, rho double, metallicity double, sfr double, stellar_age double"
#: Byte offsets within the header record.
_FIELDS = {"num_part_file": (0, "<6i"), "mass_table": (24, "<6d"), "time": (72, "<d"), "redshift": (80, "<d"), "num_part": (96, "<6i"), "n_files": (124, "<i"), "box_size": (128, "<d"), "omega0": (136, "<d"), "omega_lambda": (144, "<d"), "hubble": (152, "<d")}
_HEADER = 256
_EXTRA = {"POT": ("potential", tuple(range(6))), "Z": ("metallicity", (GAS, STAR)), "SFR": ("sfr", (GAS,)), "AGE": ("stellar_age", (STAR,))}


def layout(name: str) -> int:
    """1 or 2."""
    kind = str(name).upper()
    if kind in ("1", "SNAP1", "GADGET1"):
        return 1
    if kind in ("2", "SNAP2", "GADGET2"):
        return 2
    raise ValueError(f"format is SNAP1 or SNAP2, not {name!r}")


def read_header(path: str, kind: int) -> tuple[SimHeader, tuple[int, ...]]:
    """The header, and the file's own numbers of particles."""
    with open_file(path) as f:
        f.seek(4 if kind == 1 else 20)
        raw = f.read(_HEADER)
    v = {k: struct.unpack_from(form, raw, at) for k, (at, form) in _FIELDS.items()}
    header = SimHeader(scale_factor=v["time"][0], box_size=v["box_size"][0], omega0=v["omega0"][0], omega_lambda=v["omega_lambda"][0], hubble=v["hubble"][0], num_part=v["num_part"], mass_table=v["mass_table"], n_files=max(1, v["n_files"][0]))
    return header, v["num_part_file"]


def _with_mass(header: SimHeader) -> list[int]:
    return [t for t in range(6) if header.mass_table[t] == 0]


def directory(path: str, kind: int, id_bytes: int) -> dict[str, int]:
    """Where each block's payload begins.  SNAP2 files name their blocks; SNAP1 files have them in a fixed order."""
    header, own = read_header(path, kind)
    n, gas = sum(own), own[GAS]
    sizes = {"POS": 12 * n, "VEL": 12 * n, "ID": id_bytes * n, "MASS": 4 * sum(own[t] for t in _with_mass(header)), "U": 4 * gas, "RHO": 4 * gas}
    found: dict[str, int] = {}
    if kind == 1:
        at = 8 + _HEADER
        for tag, size in sizes.items():
            if size:
                found[tag] = at + 4
                at += 8 + size
        return found
    with open_file(path) as f:
        at, end = 0, f.size()
        while at + 16 <= end:
            f.seek(at)
            _, tag, size, _ = struct.unpack("<i4sii", f.read(16))
            name = tag.decode("ascii").strip().upper()
            found["ID" if name == "IDS" else name] = at + 20
            at += 16 + size
    return found


def block_names(path: str, kind: str | int = "SNAP2", id_bytes: int = 4) -> list[tuple[str, int]]:
    """(tag, offset of the payload); SNAP1 files hold no names."""
    if layout(str(kind)) == 1:
        raise ValueError("SNAP1 files hold no block names")
    return sorted(directory(path, 2, id_bytes).items(), key=lambda x: x[1])


def block_table(spark: SparkSession, path: str, kind: str | int = "SNAP2", id_bytes: int = 4) -> DataFrame:
    """file, tag, offset of each named block of a file, or of each file of a list with commas between: a row a block."""
    rows = [(name, tag, at) for name in path.split(",") for tag, at in block_names(name, kind, id_bytes)]
    return spark.createDataFrame(rows, "file string, tag string, offset bigint")


@dataclass
class _Rows(InputPartition):
    file: str
    ptype: int
    first: int  # of the type, in this file
    n: int
    row_id: int


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.kind = layout(options.get("format", "SNAP1"))
        self.id_type = np.dtype("<u8") if options.get("pids_type", "uint32") in ("uint64", "int64", "long") else np.dtype("<u4")
        self.extra = [x.strip().upper() for x in options.get("extra_blocks", "").split(",") if x.strip()]
        if self.extra and self.kind == 1:
            raise ValueError("extra blocks are found by name, which SNAP1 files don't hold")
        self.types = set(range(6)) - (set(LOW_RES_TYPES) if options.get("hires_only", "false").lower() == "true" else set())
        self.path, self.per_task = options["path"], int(options.get("rows_per_task", 2_000_000))
        self.names = schema.names

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ptype",):
                self.types &= {f.value}
            elif isinstance(f, In) and f.attribute == ("ptype",):
                self.types &= set(f.value)
            yield f  # Spark tests rows again

    def partitions(self) -> list[_Rows]:
        first = numbered(self.path)[0]
        header, _ = read_header(first, self.kind)
        files = all_parts(first, header.n_files)
        own = [read_header(f, self.kind)[1] for f in files]
        out = []
        base = 0
        for t in range(6):
            for f, n in zip(files, own, strict=True):
                if t in self.types:
                    out += [_Rows(f, t, k, min(self.per_task, n[t] - k), base + k) for k in range(0, n[t], self.per_task)]
                base += n[t]
        return out

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        header, own = read_header(part.file, self.kind)
        at = directory(part.file, self.kind, self.id_type.itemsize)
        before = sum(own[: part.ptype]) + part.first
        step = 262_144
        with open_file(part.file) as f:

            def block(tag: str, skip: int, n: int, dtype: np.dtype, width: int = 1) -> np.ndarray:
                size = dtype.itemsize * width
                f.seek(at[tag] + skip * size)
                out = np.frombuffer(f.read(n * size), dtype=dtype)
                return out.reshape(n, width) if width > 1 else out

            def of_types(types: tuple[int, ...], a: int) -> int | None:
                return sum(own[t] for t in types if t < part.ptype) + part.first + a if part.ptype in types else None

            real = np.dtype("<f4")
            for a in range(0, part.n, step):
                n = min(step, part.n - a)
                out: dict[str, np.ndarray | None] = {"row_id": np.arange(part.row_id + a, part.row_id + a + n), "ptype": np.full(n, part.ptype, dtype=np.int32)}
                want = set(self.names)
                for tag, columns in (("POS", ("x", "y", "z")), ("VEL", ("vx", "vy", "vz"))):
                    if want & set(columns):
                        xyz = block(tag, before + a, n, real, 3).astype(np.float64)
                        out |= {c: xyz[:, k] for k, c in enumerate(columns)}
                if "pid" in want:
                    out["pid"] = block("ID", before + a, n, self.id_type).astype(np.int64)
                if "mass" in want:
                    skip = of_types(tuple(_with_mass(header)), a)
                    out["mass"] = np.full(n, header.mass_table[part.ptype]) if skip is None else block("MASS", skip, n, real).astype(np.float64)
                for tag, column in (("U", "u"), ("RHO", "rho")):
                    if column in want and part.ptype == GAS and tag in at:
                        out[column] = block(tag, part.first + a, n, real).astype(np.float64)
                for tag, (column, types) in _EXTRA.items():
                    if tag in self.extra and column in want and tag in at and (skip := of_types(types, a)) is not None:
                        out[column] = block(tag, skip, n, real).astype(np.float64)
                kinds = {"row_id": pa.int64(), "pid": pa.int64(), "ptype": pa.int32()}
                arrays = [pa.array(out[c], kinds.get(c, pa.float64())) if out.get(c) is not None else pa.nulls(n, kinds.get(c, pa.float64())) for c in self.names]
                yield pa.RecordBatch.from_arrays(arrays, self.names)


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        parts = dict(x.split(" ") for x in SCHEMA.split(", "))
        return ", ".join(f"{c} {parts[c]}" for c in wanted) if wanted else SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
