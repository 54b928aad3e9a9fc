"""Canonical schemas, one for each entity; readers rename native columns to these."""

from __future__ import annotations

from pyspark.sql import types as T

DDL = {
    "sim_header": "snapnum int, scale_factor double, redshift double, box_size double, omega0 double, omega_lambda double, omega_bar double, hubble double, num_part array<bigint>, mass_table array<double>",
    "particles": "row_id bigint, pid bigint, ptype int, x double, y double, z double, vx double, vy double, vz double, mass double, potential double, u double, rho double, hsml double, metallicity double, sfr double, stellar_age double, stellar_init_mass double, stellar_gen int",
    "halos": "row_id bigint, halo_id bigint, host_id bigint, structuretype int, n_sub int, npart bigint, mass double, m200 double, r200 double, mfof double, so_m200 double, so_r200 double, ekin double, epot double, x double, y double, z double, vx double, vy double, vz double, x_cm double, y_cm double, z_cm double, x_mbp double, y_mbp double, z_mbp double, first_sub bigint, offset bigint, offset_type array<bigint>",
    "subhalos": "row_id bigint, group_id bigint, sub_rank int, len bigint, len_type array<bigint>, offset bigint, offset_type array<bigint>, x double, y double, z double, vx double, vy double, vz double, mass double",
    "halo_particles": "halo_id bigint, member_rank bigint, pid bigint, ptype int, bound boolean",
    "substructure": "host_id bigint, sub_id bigint",
    "tree_nodes": "tree_id bigint, tree_index bigint, snapnum int, node_id bigint, group_nr bigint, subhalo_nr bigint, host_id bigint, redshift double, scale_factor double, mass double, m200 double, x double, y double, z double, vx double, vy double, vz double, vdisp double, vmax double, rmax double, main_prog bigint, first_prog bigint, prog bigint, next_prog bigint, desc bigint, first_desc bigint, next_desc bigint, first_in_fof bigint, next_in_fof bigint, prog_snap int, root_tail_snap int, root_head bigint, root_tail bigint, root_head_snap int, mfof double",
    "tree_table": "tree_id bigint, length bigint, start_offset bigint",
    "tree_links": "desc_id bigint, prog_rank int, prog_id bigint",
    "galaxies": "row_id bigint, x double, y double, z double, vx double, vy double, vz double, mstar_disk double, mstar_bulge double, mgas_disk double, mgas_bulge double, matom_disk double, matom_bulge double",
    "grid": "ix int, iy int, iz int, value double",
    "sidecar": "file string, key string, value string, type string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


#: Of each particle column: the factor to cgs units, and the powers of the scale factor and of h that its values hold.
UNITS = {
    "pid": ("one", 0, 0),
    "metallicity": ("one", 0, 0),
    "stellar_age": ("one", 0, 0),
    "stellar_gen": ("one", 0, 0),
    "sfr": ("mass_rate", 0, 0),
    "stellar_init_mass": ("mass", 0, -1),
    **{c: ("length", 1, -1) for c in ("x", "y", "z", "hsml")},
    **{c: ("velocity", 0.5, 0) for c in ("vx", "vy", "vz")},
    "mass": ("mass", 0, -1),
    "u": ("velocity2", 0, 0),
    "rho": ("density", -3, 2),
    "potential": ("velocity2", -1, 0),
}


def unit_of(column: str) -> tuple[float, float, float]:
    """The factor to cgs units, and the powers of the scale factor and of h that a particle column's values hold."""
    from haloforge import cosmology as c

    mass, length, speed = 1e10 * c.SOLAR_MASS_IN_CGS, c.KPC_IN_CGS, c.KM_PER_SEC_IN_CGS
    cgs = {"one": 1.0, "length": length, "velocity": speed, "mass": mass, "velocity2": speed**2, "density": mass / length**3, "mass_rate": c.SOLAR_MASS_IN_CGS / c.YEAR_IN_CGS}
    kind, a, h = UNITS[column]
    return cgs[kind], float(a), float(h)


def with_units(df):
    """``df`` with unit metadata on each particle column that has units."""
    for name in UNITS:
        if name in df.columns:
            df = df.withMetadata(name, dict(zip(("cgs_factor", "a_exponent", "h_exponent"), unit_of(name), strict=True)))
    return df
