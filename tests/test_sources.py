"""Files written here byte by byte, and read back."""

import struct

import numpy as np
import pytest

from haloforge.cosmology import SimHeader
from haloforge.sources import files, hdf5, snapshot_binary, store, text


def write_snapshot(path, kind, own, total, mass_table, n_files, rng, ids=np.uint32):
    """One file; returns its columns by type."""
    head = bytearray(256)
    for (at, form), v in ((snapshot_binary._FIELDS[k], v) for k, v in dict(num_part_file=own, mass_table=mass_table, time=[0.5], redshift=[1.0], num_part=total, n_files=[n_files], box_size=[100.0], omega0=[0.3], omega_lambda=[0.7], hubble=[0.7]).items()):
        struct.pack_into(form, head, at, *v)
    n, gas, own_mass = sum(own), own[0], sum(c for c, m in zip(own, mass_table, strict=True) if m == 0)
    data = {
        "POS ": rng.random((n, 3), dtype=np.float32), "VEL ": rng.random((n, 3), dtype=np.float32), "ID  ": rng.integers(1, 1 << 31, n).astype(ids), "MASS": rng.random(own_mass, dtype=np.float32),
        "U   ": rng.random(gas, dtype=np.float32), "RHO ": rng.random(gas, dtype=np.float32), "POT ": rng.random(n, dtype=np.float32), "Z   ": rng.random(gas + own[4], dtype=np.float32), "AGE ": rng.random(own[4], dtype=np.float32),
    }
    with open(path, "wb") as f:
        for tag, payload in {"HEAD": bytes(head), **data}.items():
            raw = payload if isinstance(payload, bytes) else payload.tobytes()
            if kind == 1 and tag in ("POT ", "Z   ", "AGE ") or not raw:
                continue
            if kind == 2:
                f.write(struct.pack("<i4sii", 8, tag.encode(), len(raw) + 8, 8))
            f.write(struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(raw)))
    return data


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("n_files", [1, 2])
def test_binary_snapshot(spark, tmp_path, kind, n_files):
    rng = np.random.default_rng(kind)
    snapshot_binary.register(spark)
    table, own = [0.0, 1.5, 0.0, 0.0, 0.0, 0.0], [(3, 5, 2, 0, 4, 0), (2, 1, 0, 0, 1, 0)][:n_files]
    total = [sum(x) for x in zip(*own, strict=True)]
    parts = [write_snapshot(tmp_path / (f"snap.{k}" if n_files > 1 else "snap"), kind, o, total, table, n_files, rng) for k, o in enumerate(own)]
    reader = spark.read.format("snapshot").option("format", f"SNAP{kind}").option("rows_per_task", 2)
    if kind == 2:
        reader = reader.option("extra_blocks", "POT,Z,AGE")
    found = reader.load(str(tmp_path / "snap")).orderBy("row_id").toPandas()
    assert found.row_id.tolist() == list(range(sum(total))) and found.groupby("ptype").size().to_dict() == {t: c for t, c in enumerate(total) if c}
    want = {t: [] for t in range(6)}
    for o, d in zip(own, parts, strict=True):
        at = mass_at = 0
        for t in range(6):
            for k in range(o[t]):
                own_mass = d["MASS"][mass_at + k] if table[t] == 0 else table[t]
                z = d["Z   "][k + (o[0] if t == 4 else 0)] if t in (0, 4) else None
                want[t].append((*d["POS "][at + k], int(d["ID  "][at + k]), own_mass, d["U   "][k] if t == 0 else None, d["POT "][at + k], z, d["AGE "][k] if t == 4 else None))
            at += o[t]
            mass_at += o[t] if table[t] == 0 else 0
    rows = [r for t in range(6) for r in want[t]]
    for k, column in enumerate(("x", "y", "z", "pid", "mass", "u", "potential", "metallicity", "stellar_age")):
        if kind == 1 and k > 5:
            assert found[column].isna().all()
            continue
        mine = [float(r[k]) if r[k] is not None else np.nan for r in rows]
        assert np.allclose(found[column].astype(float), mine, equal_nan=True), column
    some = spark.read.format("snapshot").option("format", f"SNAP{kind}").option("columns", "x,ptype").load(str(tmp_path / "snap")).where("ptype = 4")
    assert some.columns == ["x", "ptype"] and some.count() == total[4]
    hires = spark.read.format("snapshot").option("format", f"SNAP{kind}").option("hires_only", "true").load(str(tmp_path / "snap"))
    assert hires.count() == sum(total) - total[2]
    first = files.numbered(str(tmp_path / "snap"))[0]
    header, _ = snapshot_binary.read_header(first, kind)
    assert header.box_size == 100.0 and header.redshift == 1.0 and header.num_part == tuple(total)
    if kind == 2:
        assert [t for t, _ in snapshot_binary.block_names(first)][:4] == ["HEAD", "POS", "VEL", "ID"]
        table = snapshot_binary.block_table(spark, f"{first},{first}").collect()
        assert sorted({(r.tag, r.offset) for r in table}) == sorted(snapshot_binary.block_names(first)) and len(table) == 2 * len(snapshot_binary.block_names(first))
    else:
        with pytest.raises(ValueError):
            snapshot_binary.block_names(first, "SNAP1")


def test_missing_snapshot(tmp_path):
    with pytest.raises(FileNotFoundError):
        files.numbered(str(tmp_path / "none"))


def test_text_sources(spark, tmp_path):
    text.register(spark)
    (tmp_path / "m").write_text("2\n2 7\n11 1\n12 1\n1 8\n13 4\n")
    read = lambda kind, name: [tuple(r) for r in spark.read.format("halo_text").option("kind", kind).load(str(tmp_path / name)).collect()]
    assert read("members", "m") == [(0, 7, 0, 11, 1), (0, 7, 1, 12, 1), (1, 8, 0, 13, 4)]
    (tmp_path / "s").write_text("5 2\n9 3\n6 0\n\n7 1\n4\n")
    assert sorted(read("substructure", "s"))[:2] == [(5, 3), (5, 9)]
    (tmp_path / "l").write_text("a\nb\nc\n5 2\n3\n4\n3 0\nEND\n")
    assert read("links", "l") == [(5, 0, 3), (5, 1, 4)]
    (tmp_path / "h").write_text("#ID host\n" + " ".join(map(str, range(1, 18))) + "\n  9 0 1 2.5 4 " + " ".join(["1.0"] * 12) + "\n")
    halos = text.halo_list(spark, str(tmp_path / "h")).orderBy("row_id").collect()
    assert [(h.halo_id, h.host_id, h.r200) for h in halos] == [(1, 2, 12.0), (9, 0, 1.0)] and halos[0].vmax == 17.0


def test_sidecar(spark, tmp_path):
    (tmp_path / "a.siminfo").write_text("Cosmological_Sim : 1 # int32\nScaleFactor : 1.0 # float64\n")
    (tmp_path / "a.configuration").write_text("Names=a,b, # str\nEmpty= #\n")
    found = {(r.key, r.value, r.type) for r in text.sidecar(spark, f"{tmp_path}/a.*").collect()}
    assert found == {("Cosmological_Sim", "1", "int32"), ("ScaleFactor", "1.0", "float64"), ("Names", "a,b,", "str"), ("Empty", "", "")}


def test_store_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, 0, 1.0, 2.0), (2, 4, 3.0, 4.0)], "pid long, ptype int, x double, mass double")
    header = SimHeader(scale_factor=0.5, box_size=10.0, omega0=0.3, omega_lambda=0.7, hubble=0.7, omega_bar=0.05, mass_table=(1.0,) * 6)
    store.write_snapshot(p, header, str(tmp_path / "s"))
    back, h = store.read_snapshot(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("pid", "ptype", "x", "mass").collect())) == [(1, 0, 1.0, 2.0), (2, 4, 3.0, 4.0)]
    assert h.num_part == (1, 0, 0, 0, 1, 0) and h.mass_table == (0.0,) * 6 and h.redshift == 1.0
    assert store.dialect(h, "SWIFT", h.num_part)["Cosmology"]["Omega_cdm"] == pytest.approx(0.25)
    assert "Parameters" in store.dialect(h, "AREPO", h.num_part) and store.dialect(h, "GADGET", h.num_part)["Header"]["Redshift"] == 1.0
    assert store.dialect(h, "SWIFT", h.num_part, range(7))["Selection"]["Velocity"] == [3, 4, 5]


def test_hdf5_is_optional():
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            hdf5.snapshot_header("none")
