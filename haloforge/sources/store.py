"""The library's own storage: Parquet by particle type, with a one-row header table beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haloforge.cosmology import SimHeader
from haloforge.schemas import schema, with_units


def header_row(header: SimHeader, num_part: Sequence[int] | None = None) -> tuple:
    return (
        header.snapnum, float(header.scale_factor), header.redshift, float(header.box_size), float(header.omega0), float(header.omega_lambda),
        header.omega_bar, float(header.hubble), [int(x) for x in (num_part or header.num_part)], [float(x) for x in header.mass_table],
    )


def dialect(header: SimHeader, kind: str, num_part: Sequence[int], selection: Sequence[float] | None = None, run_label: str | None = None, periodic: bool = True) -> dict[str, dict]:
    """Groups of header attributes as other programs name them: SWIFT, GADGET4 (AREPO too), or the older form.  Counts beyond 32 bits are in two words."""
    low, high = [int(n) & 0xFFFFFFFF for n in num_part], [int(n) >> 32 for n in num_part]
    common = {"NumPart_Total": low, "NumPart_Total_HighWord": high, "NumPart_ThisFile": list(num_part), "MassTable": [0.0] * len(num_part), "NumFilesPerSnapshot": 1, "Flag_Entropy_ICs": 1}
    common |= {"RunLabel": kind if run_label is None else run_label, "Periodic": int(periodic)}
    if selection is not None:
        if len(selection) != 7:
            raise ValueError("a selection is centre (3), velocity (3) and extent")
        common |= {"Halo Centre": list(selection[:3]), "Halo Systemic Velocity": list(selection[3:6]), "Halo Extent": selection[6]}
    kind = kind.upper()
    if kind == "SWIFT":
        out = {"Header": common | {"Scale-factor": header.scale_factor, "BoxSize": [header.box_size] * 3, "Dimension": 3}, "Cosmology": {"Omega_cdm": header.omega0 - (header.omega_bar or 0.0), "Omega_b": header.omega_bar or 0.0, "Omega_lambda": header.omega_lambda, "h": header.hubble}}
    elif kind in ("GADGET4", "AREPO"):
        out = {"Header": common | {"Time": header.scale_factor, "Redshift": header.redshift, "BoxSize": header.box_size}, "Parameters": {"Omega0": header.omega0, "OmegaLambda": header.omega_lambda, "HubbleParam": header.hubble}}
    else:
        out = {"Header": common | {"Time": header.scale_factor, "Redshift": header.redshift, "BoxSize": header.box_size, "Omega0": header.omega0, "OmegaLambda": header.omega_lambda, "HubbleParam": header.hubble, "Flag_Sfr": 0, "Flag_Cooling": 0, "Flag_StellarAge": 0, "Flag_Metals": 0, "Flag_Feedback": 0, "Flag_DoublePrecision": 0}}
    if selection is not None:
        out["Selection"] = {"Centre": list(selection[:3]), "Velocity": list(selection[3:6]), "Extent": selection[6]}
    return out


def write_snapshot(particles: DataFrame, header: SimHeader, path: str, mode: str = "errorifexists") -> None:
    """``path``/particles, by ptype, and ``path``/header.  Every particle has its own mass, so the mass table is 0."""
    with_units(particles).write.mode(mode).partitionBy("ptype").parquet(f"{path}/particles")
    spark = particles.sparkSession
    counts = {r.ptype: r.n for r in spark.read.parquet(f"{path}/particles").groupBy("ptype").agg(F.count("*").alias("n")).collect()}  # a handful
    n = [counts.get(t, 0) for t in range(6)]
    row = header_row(SimHeader(**{**header.__dict__, "mass_table": (0.0,) * 6}), n)
    spark.createDataFrame([row], schema("sim_header")).write.mode(mode).parquet(f"{path}/header")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, SimHeader]:
    r = spark.read.schema(schema("sim_header")).parquet(f"{path}/header").first()
    header = SimHeader(r.scale_factor, r.box_size, r.omega0, r.omega_lambda, r.hubble, r.omega_bar, tuple(r.num_part), tuple(r.mass_table), 1, r.snapnum)
    return spark.read.parquet(f"{path}/particles"), header
