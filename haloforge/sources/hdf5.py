"""HDF5 sources and snapshots to write, for sites that have h5py: ``spark.read.format("hdf5_entity")``, ``df.write.format("hdf5_entity")``.

Options: path; entity (particles, halos, subhalos, halo_groups, halo_particles, tree_nodes, tree_table, tree_snapshots,
galaxies); convention (SWIFT, GADGET4, AREPO, GADGET, SUBFIND, EAGLE, VELOCIRAPTOR, TREEFROG, SHARK); comoving; suffix.
``columns`` names those that are wanted, ``positions_only`` stands for the positions, ``hires_only`` leaves low-resolution types out and
``ptypes`` names types; ``mass_block`` is the name of the masses' dataset, if it is none of the usual ones; a filter on ptype or snapnum picks groups, too.  Datasets of other columns and groups aren't read.

A layout lists for each canonical column the dataset (and component) it comes from; a task reads one range of rows
of one group of one file.  Without h5py everything else in the library works.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from haloforge.cosmology import GAS, LOW_RES_TYPES, STAR, SimHeader, redshift, scale_factor
from haloforge.schemas import DDL, unit_of
from haloforge.sources.files import all_parts, numbered
from haloforge.sources.store import dialect

_XYZ = [("x", 0), ("y", 1), ("z", 2)]
_V = [("vx", 0), ("vy", 1), ("vz", 2)]


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 sources need h5py") from e
    return h5py


def _vector(names: list[tuple[str, int]], dataset: str) -> dict[str, tuple[str, int | None]]:
    return {n: (dataset, k) for n, k in names}


def _scalars(**columns: str) -> dict[str, tuple[str, int | None]]:
    return {c: (d, None) for c, d in columns.items()}


_PARTICLE = _vector(_XYZ, "Coordinates") | _vector(_V, "Velocities") | _scalars(pid="ParticleIDs", mass="Masses|Mass|DynamicalMasses", potential="Potential")
_PARTICLE |= _scalars(u="InternalEnergies|InternalEnergy", rho="Densities|Density", hsml="SmoothingLength|SmoothingLengths", metallicity="Metallicity", sfr="StarFormationRate", stellar_age="StellarFormationTime", stellar_gen="ID_Generations", stellar_init_mass="StellarInitMass")

#: (entity, convention) -> group, columns.  ``a|b``: the first that is there; a missing dataset is null.
LAYOUTS: dict[tuple[str, str], tuple[str, dict[str, tuple[str, int | None]]]] = {
    ("halos", "SUBFIND"): ("Group", _vector(_XYZ, "GroupPos") | _vector(_V, "GroupVel") | _scalars(mass="GroupMass", m200="Group_M_Crit200", r200="Group_R_Crit200", npart="GroupLen", n_sub="GroupNsubs", first_sub="GroupFirstSub", offset_type="GroupOffsetType")),
    ("subhalos", "SUBFIND"): ("Subhalo", _vector(_XYZ, "SubhaloPos") | _vector(_V, "SubhaloVel") | _scalars(mass="SubhaloMass", len="SubhaloLen", len_type="SubhaloLenType", offset_type="SubhaloOffsetType", group_id="SubhaloGroupNr|SubhaloGrNr")),
    ("halos", "EAGLE"): ("FOF", _vector(_XYZ, "GroupCentreOfPotential") | _scalars(mass="GroupMass", m200="Group_M_Crit200", r200="Group_R_Crit200", npart="GroupLength", n_sub="NumOfSubhalos", first_sub="FirstSubhaloID", offset="GroupOffset")),
    ("subhalos", "EAGLE"): ("Subhalo", _vector(_XYZ, "CentreOfPotential") | _vector(_V, "Velocity") | _scalars(mass="Mass", group_id="GroupNumber", sub_rank="SubGroupNumber", len_type="SubLengthType", offset="SubOffset")),
    ("halos", "VELOCIRAPTOR"): ("/", _scalars(halo_id="ID", host_id="hostHaloID", structuretype="Structuretype", n_sub="numSubStruct", npart="npart", mass="Mass_tot", m200="Mass_200crit", mfof="Mass_FOF", r200="R_200crit", ekin="Ekin", epot="Epot", x="Xcminpot", y="Ycminpot", z="Zcminpot", vx="VXcminpot", vy="VYcminpot", vz="VZcminpot", x_cm="Xc", y_cm="Yc", z_cm="Zc", x_mbp="Xcmbp", y_mbp="Ycmbp", z_mbp="Zcmbp", so_m200="SO_Mass_200.000000_rhocrit", so_r200="SO_R_200.000000_rhocrit")),
    ("halo_groups", "VELOCIRAPTOR"): ("/", _scalars(length="Group_Size", offset="Offset", offset_unbound="Offset_unbound", file_id="File_id")),
    ("halo_particles", "VELOCIRAPTOR"): ("/", _scalars(pid="Particle_IDs")),
    ("tree_nodes", "SUBFIND"): ("TreeHalos", _vector(_XYZ, "SubhaloPos") | _vector(_V, "SubhaloVel") | _scalars(tree_id="TreeID", tree_index="TreeIndex", snapnum="SnapNum", group_nr="GroupNr", subhalo_nr="SubhaloNr", mass="SubhaloMass", m200="Group_M_Crit200", vdisp="SubhaloVelDisp", vmax="SubhaloVmax", rmax="SubhaloVmaxRad", main_prog="TreeMainProgenitor", first_prog="TreeFirstProgenitor", prog="TreeProgenitor", next_prog="TreeNextProgenitor", desc="TreeDescendant", first_desc="TreeFirstDescendant", next_desc="TreeNextDescendant", first_in_fof="TreeFirstHaloInFOFgroup", next_in_fof="TreeNextHaloInFOFgroup")),
    ("tree_snapshots", "SUBFIND"): ("TreeTimes", _scalars(redshift="Redshift", scale_factor="Time")),
    ("tree_table", "SUBFIND"): ("TreeTable", _scalars(tree_id="TreeID", length="Length", start_offset="StartOffset")),
    ("tree_nodes", "TREEFROG"): ("Snap_", _scalars(node_id="ID", prog="Progenitor", prog_snap="ProgenitorSnap", root_tail_snap="RootTailSnap", root_head="RootHead", root_tail="RootTail", root_head_snap="RootHeadSnap", mfof="Mass_FOF", host_id="hostHaloID", mass="Mass_tot", m200="Mass_200crit", x="Xcminpot", y="Ycminpot", z="Zcminpot", vx="VXc", vy="VYc", vz="VZc", vdisp="sigV", vmax="Vmax", rmax="Rmax")),
    ("galaxies", "SHARK"): ("galaxies", _scalars(x="position_x", y="position_y", z="position_z", vx="velocity_x", vy="velocity_y", vz="velocity_z", mstar_disk="mstars_disk", mstar_bulge="mstars_bulge", mgas_disk="mgas_disk", mgas_bulge="mgas_bulge", matom_disk="matom_disk", matom_bulge="matom_bulge")),
}
_OWN_SCHEMA = {"halo_groups": "row_id bigint, file int, length bigint, offset bigint, offset_unbound bigint, file_id bigint", "halo_particles": "row_id bigint, file int, position bigint, pid bigint, bound boolean", "tree_snapshots": "snapnum int, redshift double, scale_factor double"}
#: Whether a file's particles are bound, by its suffix.
_BOUND = {".catalog_particles": True, ".catalog_particles.unbound": False}
_SUFFIX = {("halos", "VELOCIRAPTOR"): ".properties", ("halo_groups", "VELOCIRAPTOR"): ".catalog_groups", ("halo_particles", "VELOCIRAPTOR"): ".catalog_particles"}


def snapshot_header(path: str, convention: str = "GADGET") -> SimHeader:
    """The header by convention: SWIFT, GADGET4 (and AREPO), or the older one; of a VELOCIRAPTOR catalogue, and of SUBFIND and TREEFROG
    trees, what they tell."""
    with _h5py().File(path, "r") as f:
        kind = convention.upper()
        if kind in ("VELOCIRAPTOR", "SUBFIND", "TREEFROG"):
            return _catalogue_header(f, kind)
        h = f["Header"].attrs
        if kind == "SWIFT":
            c = f["Cosmology"].attrs
            a, box, o0, ol, hub = h["Scale-factor"], np.ravel(h["BoxSize"])[0], c["Omega_cdm"] + c["Omega_b"], c["Omega_lambda"], c["h"]
        elif kind in ("GADGET4", "AREPO"):
            p = f["Parameters"].attrs
            a, box, o0, ol, hub = h["Time"], h["BoxSize"], p["Omega0"], p["OmegaLambda"], p["HubbleParam"]
        else:
            a, box, o0, ol, hub = h["Time"], h["BoxSize"], h["Omega0"], h["OmegaLambda"], h["HubbleParam"]
        low = np.ravel(h["NumPart_Total"]).astype(np.int64)
        high = np.ravel(h.get("NumPart_Total_HighWord", np.zeros_like(low))).astype(np.int64)
        n = tuple((low + (high << 32)).tolist()) if len(high) == len(low) else tuple(low.tolist())
        one = lambda x: float(np.ravel(x)[0])
        return SimHeader(one(a), one(box), one(o0), one(ol), one(hub), num_part=n, mass_table=tuple(np.ravel(h["MassTable"]).tolist()), n_files=int(np.ravel(h["NumFilesPerSnapshot"])[0]))


def _catalogue_header(f, kind: str) -> SimHeader:
    one = lambda x: np.ravel(x)[0].item()
    if kind == "VELOCIRAPTOR":
        i = f["SimulationInfo"].attrs
        files = one(f["Num_of_files"][:]) if "Num_of_files" in f else 1
        return SimHeader(one(i["ScaleFactor"]), one(i["Period"]), one(i["Omega_m"]), one(i.get("Omega_Lambda", 1.0 - one(i["Omega_m"]))), one(i["h_val"]), one(i["Omega_b"]), n_files=int(files))
    if kind == "TREEFROG":
        h = f["Header"].attrs
        return SimHeader(hubble=one(f["Header/Simulation"].attrs["h_val"]), extra={"n_snaps": int(one(h["NSnaps"])), "id_offset": int(one(f["Header/TreeBuilder"].attrs["Temporal_halo_id_value"]))})
    h, p = f["Header"].attrs, f["Parameters"].attrs
    extra = {k: int(one(h[k])) for k in ("Nhalos_Total", "Ntrees_Total") if k in h}
    return SimHeader(1.0, one(p["BoxSize"]), one(p["Omega0"]), one(p["OmegaLambda"]), one(p["HubbleParam"]), one(p["OmegaBaryon"]) if "OmegaBaryon" in p else None, n_files=int(one(h["NumFiles"])) if "NumFiles" in h else 1, snapnum=int(one(h["LastSnapShotNr"])) if "LastSnapShotNr" in h else 0, extra=extra)


def with_times(nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """tree_nodes with redshift and scale_factor of their snapshots, a table as small as the simulation has outputs; what it lacks of the two
    follows from the other."""
    a, z = F.col("scale_factor"), F.col("redshift")
    known = snapshots.select("snapnum", F.coalesce(z, redshift(a)).alias("redshift"), F.coalesce(a, scale_factor(z)).alias("scale_factor"))
    return nodes.drop("redshift", "scale_factor").join(known, "snapnum", "left").select(nodes.columns)


@dataclass
class _Rows(InputPartition):
    file: str
    group: str
    first: int
    n: int
    row_id: int
    fixed: dict = field(default_factory=dict)


class Hdf5Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.entity, self.convention = options.get("entity", "particles"), options.get("convention", "GADGET").upper()
        self.path, self.per_task = options["path"], int(options.get("rows_per_task", 1_000_000))
        self.suffixes = [options["suffix"]] if "suffix" in options else [_SUFFIX.get((self.entity, self.convention), ".hdf5")]
        if self.entity == "halo_particles" and "suffix" not in options:
            self.suffixes = [k for k, v in _BOUND.items() if options.get("bound", str(v)).lower() == str(v).lower()]
        self.mass_block = options.get("mass_block", "Masses")
        self.comoving = options.get("comoving", "false").lower() == "true"
        self.schema, self.lists = schema, {f.name for f in schema.fields if f.dataType.simpleString().startswith("array")}
        if self.entity != "particles" and (self.entity, self.convention) not in LAYOUTS:
            raise ValueError(f"no layout for {self.entity} of {self.convention}")
        self.picked: dict[str, set] = {}
        if options.get("hires_only", "false").lower() == "true":
            self.picked["ptype"] = set(range(8)) - set(LOW_RES_TYPES)
        if "ptypes" in options:
            self.picked["ptype"] = self.picked.get("ptype", set(range(8))) & {int(x) for x in options["ptypes"].split(",")}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in ("ptype", "snapnum"):
                self.picked[f.attribute[0]] = self.picked.get(f.attribute[0], values) & values
            yield f  # Spark tests rows again

    def _groups(self, name: str, table: tuple) -> list[tuple[str, int, dict]]:
        """(group, rows, what is the same for all of them) in a file."""
        with _h5py().File(name, "r") as f:
            if self.entity == "particles":
                groups = [(f"PartType{t}", {"ptype": t, "table_mass": float(table[t]) if t < len(table) else 0.0}) for t in range(8) if f"PartType{t}" in f]
            elif LAYOUTS[(self.entity, self.convention)][0] == "Snap_":
                h = float(f["Header/Simulation"].attrs["h_val"]) if "Header/Simulation" in f else 1.0
                groups = [(g, {"snapnum": int(f[g].attrs["Snapnum"]), "scale_factor": float(f[g].attrs["scalefactor"]), "h": h}) for g in sorted(f) if g.startswith("Snap_") and int(f[g].attrs.get("NHalos", 1)) > 0]
            else:
                groups = [(LAYOUTS[(self.entity, self.convention)][0], {})]
            out = []
            for group, fixed in groups:
                datasets = [d for d in f[group].values() if hasattr(d, "shape") and len(d.shape) and len(d) > 1] or [d for d in f[group].values() if hasattr(d, "shape") and len(d.shape)]
                out.append((group, max((len(d) for d in datasets), default=0), fixed))
            return out

    def partitions(self) -> list[_Rows]:
        out = []
        for suffix in self.suffixes:
            first = numbered(self.path, suffix)[0]
            with _h5py().File(first, "r") as f:
                head = dict(f["Header"].attrs) if "Header" in f else {}
                counted = next((int(np.ravel(head[k])[0]) for k in ("NumFilesPerSnapshot", "NumFiles") if k in head), None)
                n_files = counted or (int(np.ravel(f["Num_of_files"][:])[0]) if "Num_of_files" in f else 1)
            files = all_parts(first, n_files)
            table = snapshot_header(first, self.convention).mass_table if self.entity == "particles" else ()
            with ThreadPoolExecutor(16) as pool:  # opening a file is waiting
                found = list(pool.map(lambda name: self._groups(name, table), files))
            row_id = 0
            for number, (name, groups) in enumerate(zip(files, found, strict=True)):
                for group, n, fixed in groups:
                    fixed = fixed | {"file": number}
                    if suffix in _BOUND:
                        fixed = fixed | {"bound": _BOUND[suffix]}
                    if all(fixed[k] in v for k, v in self.picked.items() if k in fixed):
                        out += [_Rows(name, group, k, min(self.per_task, n - k), row_id + k, fixed) for k in range(0, n, self.per_task)]
                    row_id += n
        return out

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        columns = _PARTICLE | _scalars(mass=f"{self.mass_block}|Masses|Mass|DynamicalMasses") if self.entity == "particles" else LAYOUTS[(self.entity, self.convention)][1]
        wanted = set(self.schema.names) | ({"tree_index"} if "node_id" in self.schema.names else set())
        columns = {c: d for c, d in columns.items() if c in wanted}
        with _h5py().File(part.file, "r") as f:
            group, out = f[part.group], {"row_id": np.arange(part.row_id, part.row_id + part.n), "position": np.arange(part.first, part.first + part.n)}
            held: dict[str, np.ndarray] = {}  # a dataset of several columns is read once
            for column, (names, k) in columns.items():
                found = next((x for x in names.split("|") if x in group), None)
                if found is not None:
                    if found not in held:
                        held[found] = group[found][part.first : part.first + part.n]
                    values, whole = held[found], column in self.lists
                    out[column] = values if whole or values.ndim == 1 else values[:, k or 0]
        if self.entity == "tree_snapshots":
            out["snapnum"] = out["row_id"]
        for name in ("ptype", "snapnum", "scale_factor", "bound", "file"):
            if name in part.fixed:
                out[name] = np.full(part.n, part.fixed[name])
        if part.fixed.get("table_mass"):
            out["mass"] = np.full(part.n, part.fixed["table_mass"])
        if "scale_factor" in part.fixed:
            out["redshift"] = 1.0 / out["scale_factor"] - 1.0
            if self.comoving:
                for c in ("x", "y", "z", "mass", "m200"):
                    if c in out:
                        out[c] = out[c] * part.fixed["h"] / (part.fixed["scale_factor"] if c in "xyz" else 1.0)
        if self.entity in ("halos", "subhalos") and "halo_id" not in out:
            out["halo_id"] = out["row_id"]
        if "tree_index" in out and "node_id" not in out:
            out["node_id"] = out["tree_index"]
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        arrays = []
        for c in self.schema.fields:
            kind = kinds.get(c.dataType.simpleString())
            if c.name not in out:
                arrays.append(pa.nulls(part.n, kind or pa.list_(pa.int64())))
            elif kind is None:  # one list a row
                values = np.asarray(out[c.name]).reshape(part.n, -1)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(part.n + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel().astype(np.int64))))
            else:
                arrays.append(pa.array(out[c.name]).cast(kind, safe=False))
        yield pa.RecordBatch.from_arrays(arrays, self.schema.names)


@dataclass
class _Written(WriterCommitMessage):
    file: str
    counts: list[int]


def datasets(kind: str, ptype: int, mass_block: str = "Masses", ics: bool = False) -> list[tuple[str, list[str]]]:
    """(dataset, columns) of a type as a dialect names them.  Initial conditions have no densities, metals, star formation or stellar data."""
    many = kind.upper() == "SWIFT"
    out = [("Coordinates", ["x", "y", "z"]), ("Velocities", ["vx", "vy", "vz"]), ("ParticleIDs", ["pid"]), (mass_block, ["mass"]), ("Potential", ["potential"])]
    if ptype == GAS:
        out += [("InternalEnergies" if many else "InternalEnergy", ["u"]), ("SmoothingLengths" if many else "SmoothingLength", ["hsml"])]
        out += [] if ics else [("Densities" if many else "Density", ["rho"]), ("Metallicity", ["metallicity"]), ("StarFormationRate", ["sfr"])]
    if ptype == STAR and not ics:
        out += [("Metallicity", ["metallicity"]), ("StellarFormationTime", ["stellar_age"]), ("StellarInitMass", ["stellar_init_mass"]), ("ID_Generations", ["stellar_gen"])]
    return out


#: Names of a dataset's unit attributes.
_UNIT_ATTRIBUTES = ("CGSConversionFactor", "aexp-scale-exponent", "h-scale-exponent")
N_TYPES = 6


class Hdf5Writer(DataSourceArrowWriter):
    """Each task writes a file ``path.<number>.hdf5`` with the types' groups, and unit attributes with each dataset; at the end all get the
    header of the convention, with the counts of all, and ``path.hdf5`` shows them as one file: its datasets are virtual, and lie in the
    others.  If one task has all rows, its file is that one.

    Options: path, on a store that all tasks and the driver reach; convention; header, as ``header_option`` gives it; selection, seven
    numbers with commas between; mass_block, the masses' dataset; run_label; periodic; ics.  A column that a type has no value for is left
    out of its group; where a type has values for some rows only, the others are NaN, or 0 of integers.
    """

    def __init__(self, options: dict, schema):
        self.path, self.kind, self.names = options["path"], options.get("convention", "GADGET"), schema.names
        self.header = SimHeader(**json.loads(options["header"]))
        self.selection = [float(x) for x in options["selection"].split(",")] if "selection" in options else None
        truth = lambda name, default: options.get(name, default).lower() == "true"
        self.mass_block, self.label, self.periodic, self.ics = options.get("mass_block", "Masses"), options.get("run_label"), truth("periodic", "true"), truth("ics", "false")
        if "ptype" not in self.names:
            raise ValueError("particles to write have a ptype")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{self.path}.{context.partitionId() if context else 0}.{context.taskAttemptId() if context else 0}.part"
        counts = [0] * N_TYPES
        with _h5py().File(name, "w") as f:
            for batch in batches:
                types = batch.column(self.names.index("ptype")).to_numpy(zero_copy_only=False)
                for t in np.unique(types).tolist():
                    some = batch.filter(pa.array(types == t))
                    group = f[f"PartType{t}"] if f"PartType{t}" in f else f.create_group(f"PartType{t}")
                    self._append(group, t, counts[t], some)
                    counts[t] += some.num_rows
            for t in range(N_TYPES):
                for dataset, _ in datasets(self.kind, t, self.mass_block, self.ics) if counts[t] else ():
                    if dataset in f[f"PartType{t}"]:
                        self._grow(f[f"PartType{t}"][dataset], counts[t])
        return _Written(name, counts)

    def _grow(self, dataset, n: int) -> None:
        had = len(dataset)
        if n > had:
            dataset.resize(n, axis=0)
            dataset[had:n] = np.nan if dataset.dtype.kind == "f" else 0

    def _append(self, group, ptype: int, had: int, rows: pa.RecordBatch) -> None:
        for dataset, columns in datasets(self.kind, ptype, self.mass_block, self.ics):
            held = [rows.column(self.names.index(c)) for c in columns if c in self.names]
            if len(held) < len(columns) or any(c.null_count == len(c) for c in held):
                continue
            held = [c.fill_null(0) if pa.types.is_integer(c.type) else c for c in held]
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in held], axis=1) if len(columns) > 1 else held[0].to_numpy(zero_copy_only=False)
            if dataset not in group:
                group.create_dataset(dataset, shape=(0, *values.shape[1:]), maxshape=(None, *values.shape[1:]), dtype=values.dtype, chunks=(65_536, *values.shape[1:]))
                for attribute, value in zip(_UNIT_ATTRIBUTES, unit_of(columns[0]), strict=True):
                    group[dataset].attrs[attribute] = value
            self._grow(group[dataset], had)  # rows before, that had no value
            group[dataset].resize(had + rows.num_rows, axis=0)
            group[dataset][had : had + rows.num_rows] = values

    def _head(self, f, counts: list[int], total: list[int], n_files: int) -> None:
        for group, attributes in dialect(self.header, self.kind, total, self.selection, self.label, self.periodic).items():
            own = f[group] if group in f else f.create_group(group)
            for name, value in (attributes | ({"NumPart_ThisFile": counts, "NumFilesPerSnapshot": n_files} if group == "Header" else {})).items():
                own.attrs[name] = value

    def commit(self, messages: list[_Written | None]) -> None:
        """Number the files that have rows, write their headers, and the file that shows them as one."""
        import os

        told = [m for m in messages if m is not None]
        used = [m for m in told if sum(m.counts)] or told[:1]
        total = [sum(m.counts[t] for m in used) for t in range(N_TYPES)]
        names = [f"{self.path}.{k}.hdf5" if len(used) > 1 else f"{self.path}.hdf5" for k in range(len(used))]
        for m, name in zip(used, names, strict=True):
            with _h5py().File(m.file, "a") as f:
                self._head(f, m.counts, total, len(used))
            os.replace(m.file, name)
        if len(used) > 1:
            self._show_as_one(names, [m.counts for m in used], total)
        self.abort([m for m in told if m not in used])

    def _show_as_one(self, names: list[str], counts: list[list[int]], total: list[int]) -> None:
        import os

        with _h5py().File(f"{self.path}.hdf5", "w") as whole:
            self._head(whole, total, total, 1)
            for t in range(N_TYPES):
                if not total[t]:
                    continue
                group = whole.create_group(f"PartType{t}")
                layouts: dict = {}
                at = 0
                for name, own in zip(names, counts, strict=True):
                    if not own[t]:
                        continue
                    with _h5py().File(name, "r") as f:
                        for dataset, columns in datasets(self.kind, t, self.mass_block, self.ics):
                            if dataset in f[f"PartType{t}"]:
                                part = f[f"PartType{t}"][dataset]
                                if dataset not in layouts:
                                    layouts[dataset] = _h5py().VirtualLayout(shape=(total[t], *part.shape[1:]), dtype=part.dtype), columns
                                layouts[dataset][0][at : at + own[t]] = _h5py().VirtualSource(os.path.basename(name), f"PartType{t}/{dataset}", shape=part.shape)
                    at += own[t]
                for dataset, (layout, columns) in layouts.items():
                    group.create_virtual_dataset(dataset, layout, fillvalue=np.nan if layout.dtype.kind == "f" else 0)
                    for attribute, value in zip(_UNIT_ATTRIBUTES, unit_of(columns[0]), strict=True):
                        group[dataset].attrs[attribute] = value

    def abort(self, messages: list[_Written | None]) -> None:
        import os

        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


def header_option(header: SimHeader) -> str:
    return json.dumps(header.__dict__)


class Hdf5Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hdf5_entity"

    def schema(self) -> str:
        entity = self.options.get("entity", "particles")
        parts = dict(x.split(" ") for x in (_OWN_SCHEMA.get(entity) or DDL[entity]).split(", "))
        positions = "row_id,ptype,x,y,z" if self.options.get("positions_only", "false").lower() == "true" else ""
        wanted = [c.strip() for c in self.options.get("columns", positions).split(",") if c.strip()]
        return ", ".join(f"{c} {parts[c]}" for c in wanted or parts)

    def reader(self, schema) -> Hdf5Reader:
        return Hdf5Reader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> Hdf5Writer:
        return Hdf5Writer(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Hdf5Source)
