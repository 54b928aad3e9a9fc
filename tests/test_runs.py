"""Members of runs against a plain loop, at any bucket size, and from files."""

import random

import pytest
from pyspark.sql.types import StructType

from haloforge.operators import runs, selection, transform
from haloforge.sources import hdf5

from . import stand_in_hdf5
from .stand_in_hdf5 import group, make


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_runs_as_a_loop(spark, bucket):
    """Runs of no member, gaps between runs, positions that are no rows, columns that clash with inner names."""
    r = random.Random(1)
    listed, at = [], 0
    for k in range(40):
        at += r.choice([0, 0, 2])
        n = r.choice([0, 1, 2, 30])
        listed.append((k % 2, at, n, k, f"run{k}"))
        at += n
    rows = [(b, p, 1000 * b + p) for b in (0, 1, 2) for p in range(at + 5) if r.random() < 0.9]
    left = spark.createDataFrame(listed, "kind int, start long, length long, halo_id long, name string")
    right = spark.createDataFrame(rows, "kind int, position long, pid long").selectExpr("*", "pid as last", "pid as row")
    want = sorted((b, p, pid, h, name, p - s) for b, p, pid in rows for k, s, n, h, name in listed if k == b and s <= p < s + n)
    found = runs.run_members(left, right, ["kind"], bucket)
    assert sorted((x.kind, x.position, x.pid, x.halo_id, x["name"], x.member_rank) for x in found.collect()) == want
    assert all(x["last"] == x.pid == x["row"] for x in found.collect())


def rows_of(spark, path, **options):
    source = hdf5.Hdf5Source({"path": str(path), **options})
    schema = StructType.fromDDL(source.schema())
    reader = source.reader(schema)
    return spark.createDataFrame([tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()], schema)


def test_members_from_two_files(spark, tmp_path, monkeypatch):
    """Each file's offsets count in its own lists; a group's unbound run ends where the next one's begins, and the last at the list's end."""
    monkeypatch.setattr(hdf5, "_h5py", lambda: stand_in_hdf5)
    files = [(([4, 2], [0, 3], [0, 1]), [11, 12, 13, 21], [14, 22]), (([3, 0, 2], [0, 1, 1], [0, 2, 2]), [31, 51], [32, 33, 52])]
    for k, ((size, offset, loose), bound, unbound) in enumerate(files):
        make(tmp_path / f"c.catalog_groups.{k}", Num_of_files=[2], Group_Size=size, Offset=offset, Offset_unbound=loose, File_id=[k] * len(size))
        make(tmp_path / f"c.properties.{k}", Num_of_files=[2], ID=[100 * (k + 1) + j for j in range(len(size))], hostHaloID=[-1] * len(size))
        make(tmp_path / f"c.catalog_particles.{k}", Num_of_files=[2], Particle_IDs=bound)
        make(tmp_path / f"c.catalog_particles.unbound.{k}", Num_of_files=[2], Particle_IDs=unbound)
    groups = rows_of(spark, tmp_path / "c", entity="halo_groups", convention="VELOCIRAPTOR")
    halos = rows_of(spark, tmp_path / "c", entity="halos", convention="VELOCIRAPTOR")
    particles = rows_of(spark, tmp_path / "c", entity="halo_particles", convention="VELOCIRAPTOR", bound="true").union(rows_of(spark, tmp_path / "c", entity="halo_particles", convention="VELOCIRAPTOR", bound="false"))
    for bucket in (1, 2, None):
        found = sorted(tuple(x) for x in runs.group_members(groups, particles, halos, bucket).collect())
        assert found == [(100, 0, 11, True), (100, 1, 12, True), (100, 2, 13, True), (100, 3, 14, False), (101, 0, 21, True), (101, 1, 22, False), (200, 0, 31, True), (200, 1, 32, False), (200, 2, 33, False), (202, 0, 51, True), (202, 1, 52, False)]
    assert {x.halo_id for x in runs.group_members(groups, particles).collect()} == {0, 1, 2, 4}
    stars = spark.createDataFrame([(p, 0) for p in (12, 33, 99)], "pid long, ptype int")
    assert {x.pid for x in selection.particles_in_region(stars, region="FOF", members=runs.group_members(groups, particles, halos)).collect()} == {12, 33}


def test_members_by_type_from_files(spark, tmp_path, monkeypatch):
    """Offsets and lengths by type, over snapshots in two files, whose types' rows follow each other from file to file."""
    monkeypatch.setattr(hdf5, "_h5py", lambda: stand_in_hdf5)
    stand_in_hdf5.File.touched.clear()
    offsets, lengths = [[0, 1, 0, 0, 0, 0], [2, 1, 0, 0, 0, 0], [3, 4, 0, 0, 0, 0]], [[2, 0, 0, 0, 0, 0], [1, 3, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0]]
    make(tmp_path / "f.hdf5", Header=group({"NumFiles": 1}), Group=group(GroupMass=[1.0, 2.0], GroupOffsetType=[[0] * 6, [3, 4, 0, 0, 0, 0]]), Subhalo=group(SubhaloMass=[1.0] * 3, SubhaloLen=[2, 4, 1], SubhaloLenType=lengths, SubhaloOffsetType=offsets, SubhaloGroupNr=[0, 0, 1]))
    subs = rows_of(spark, tmp_path / "f", entity="subhalos", convention="SUBFIND")
    assert [x.offset_type for x in subs.orderBy("row_id").collect()] == offsets and [x.len_type for x in subs.orderBy("row_id").collect()] == lengths
    assert [x.offset_type for x in rows_of(spark, tmp_path / "f", entity="halos", convention="SUBFIND").orderBy("row_id").collect()] == [[0] * 6, [3, 4, 0, 0, 0, 0]]
    head = {"Time": 1.0, "BoxSize": 1.0, "Omega0": 0.3, "OmegaLambda": 0.7, "HubbleParam": 0.7, "NumPart_Total": [4, 5, 0, 0, 0, 0], "MassTable": [1.0] * 6, "NumFilesPerSnapshot": 2}
    for k, (gas, dark) in enumerate([([1, 2], [51, 52, 53]), ([3, 4], [54, 55])]):
        make(tmp_path / f"s.{k}.hdf5", Header=group(head), PartType0=group(ParticleIDs=gas, Coordinates=[[0.0, 1.0, 2.0]] * 2), PartType1=group(ParticleIDs=dark, Coordinates=[[0.0, 1.0, 2.0]] * len(dark)))
    stand_in_hdf5.File.touched.clear()
    particles = transform.type_positions(rows_of(spark, tmp_path / "s", entity="particles", columns="row_id,ptype,pid,x,y,z"))
    assert stand_in_hdf5.File.touched.count("Coordinates") == 4, "once for each group of each file"
    found = sorted((x.sub, x.ptype, x.member_rank, x.pid) for x in runs.members_by_type(subs.withColumnRenamed("row_id", "sub"), particles, "sub").collect())
    assert found == [(0, 0, 0, 1), (0, 0, 1, 2), (1, 0, 0, 3), (1, 1, 0, 52), (1, 1, 1, 53), (1, 1, 2, 54), (2, 1, 0, 55)]


def test_eagle_offsets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hdf5, "_h5py", lambda: stand_in_hdf5)
    for k in range(2):
        make(tmp_path / f"e.{k}.hdf5", Header=group({"NumFilesPerSnapshot": 2}), FOF=group(GroupMass=[1.0, 2.0], GroupLength=[5, 6], GroupOffset=[11 * k, 11 * k + 5]), Subhalo=group(Mass=[1.0] * 2, SubLengthType=[[1, 2, 0, 0, 3, k], [0] * 6], SubOffset=[7 * k, 7 * k + 1], GroupNumber=[1, 1], SubGroupNumber=[0, 1]))
    halos, subs = (rows_of(spark, tmp_path / "e", entity=e, convention="EAGLE").orderBy("row_id").collect() for e in ("halos", "subhalos"))
    assert [x.offset for x in halos] == [0, 5, 11, 16] and [x.offset for x in subs] == [0, 1, 7, 8]
    assert [x.len_type for x in subs] == [[1, 2, 0, 0, 3, 0], [0] * 6, [1, 2, 0, 0, 3, 1], [0] * 6]
