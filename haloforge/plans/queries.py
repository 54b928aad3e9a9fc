"""The registered queries over the stand-in entities; each a thin use of one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haloforge.cosmology import SimHeader
from haloforge.functions.columns import wrap
from haloforge.operators import grid as G
from haloforge.operators import profiles as P
from haloforge.operators import runs as L
from haloforge.operators import selection as S
from haloforge.operators import spatial as X
from haloforge.operators import transform as R
from haloforge.operators import tree as T
from haloforge.plans.standins import BOX, FIRST_IN_FOF, LAST_SNAP, NEXT_IN_FOF, OMEGA0, OMEGA_LAMBDA, group_lists, load, typed_lists
from haloforge.work import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EDGE = (5.0, 50.0, 95.0)  # near two borders of the box
MIDDLE = (50.0, 50.0, 50.0)
SHAPE, LIMITS = (16, 16, 16), (0.0, 100.0) * 3
HEADER = SimHeader(scale_factor=0.5, box_size=BOX, omega0=OMEGA0, omega_lambda=OMEGA_LAMBDA, hubble=0.7)
SNAP = 58


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) + F.lit(0.0) for c, n in digits.items()})


def bigint(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# Scans ---------------------------------------------------------------------------------------------------------------


@query
def positions_only_scan(spark, d):
    return load(spark, d, "particles").select("x", "y", "z")


@query
def hires_only_scan(spark, d):
    return S.hires_only(load(spark, d, "particles")).select("pid", *bigint("ptype"))


@query
def mass_table_resolution(spark, d):
    return rounded(S.resolve_mass(load(spark, d, "particles"), [0.0, 1.5, 0.0, 2.5, 0.0, 0.0]).select("pid", *bigint("ptype"), "mass"), mass=6)


@query
def satellites_only(spark, d):
    return S.satellites(load(spark, d, "subhalos")).select("sub_id", "group_id", *bigint("sub_rank"))


@query
def load_by_type(spark, d):
    return S.by_type(load(spark, d, "particles"), "star").select("pid", "x", "y", "z", "potential")


@query
def type_counts(spark, d):
    return R.type_counts(load(spark, d, "particles")).select(*bigint("ptype"), "n")


@query
def type_offsets(spark, d):
    return R.type_offsets(load(spark, d, "particles")).select(*bigint("ptype", "first", "last"))


@query
def halo_members_explode(spark, d):
    halos = load(spark, d, "halos").selectExpr("halo_id", "halo_id * 3 as offset", "halo_id % 4 as length")
    pool = load(spark, d, "galaxies").selectExpr("row_id as position", "row_id * 7 as pid")
    return S.members_of(halos, pool)


# Derived columns -----------------------------------------------------------------------------------------------------


@query
def periodic_wrap(spark, d):
    p = load(spark, d, "particles")
    return rounded(p.select("pid", *[wrap(F.col(c) - v, BOX).alias(f"d{c}") for c, v in zip("xyz", EDGE, strict=True)]), dx=9, dy=9, dz=9)


@query
def unit_conversion(spark, d):
    p = load(spark, d, "particles").select("pid", "x", "y", "z", "mass").withColumn("box_size", F.lit(BOX))
    return rounded(R.convert_units(p, HEADER, to_physical=True, per_littleh=True), x=9, y=9, z=9, mass=6, box_size=9)


@query
def mesh_cell(spark, d):
    return R.mesh_cells(load(spark, d, "particles"), (10.0, 0.0, 50.0), 80.0, 8).select("pid", *[(F.col(c) + 0.0).alias(c) for c in ("cx", "cy", "cz")])


@query
def galaxy_totals(spark, d):
    return rounded(R.galaxy_totals(load(spark, d, "galaxies")).select("row_id", "mstar_tot", "mgas_tot", "matom_tot"), mstar_tot=6, mgas_tot=6, matom_tot=6)


@query
def add_gas_particles(spark, d):
    p = R.rank_of_rows(load(spark, d, "particles").where("ptype <> 0"), "pid", "row_id")  # stand-in ids may repeat
    found = R.add_gas(p, HEADER, first_mass=10.0)
    # Masses have five decimals, and a share of them is a multiple of 1/69 at the eighth: nothing lies near a tie there.
    return rounded(found.select("pid", *bigint("ptype"), "x", "y", "z", "mass", "u"), x=7, y=7, z=7, mass=8, u=6)


# Selections ----------------------------------------------------------------------------------------------------------


@query
def select_cubic(spark, d):
    return S.select_particles(load(spark, d, "particles"), EDGE, 30.0, "cubic", True, BOX).select("pid", "x", "y", "z")


@query
def select_spherical(spark, d):
    return S.select_particles(load(spark, d, "particles"), EDGE, 15.0, "spherical", True, BOX).select("pid", "x", "y", "z")


@query
def select_with_ptype(spark, d):
    return S.select_particles(load(spark, d, "particles"), EDGE, 15.0, "spherical", True, BOX).select("pid", *bigint("ptype"))


@query
def region_sphere(spark, d):
    return S.particles_in_region(load(spark, d, "particles"), MIDDLE, 3.0, "sphere").select("pid")


@query
def region_cuboid(spark, d):
    return S.particles_in_region(load(spark, d, "particles"), MIDDLE, (2.0, 3.0, 4.0), "cuboid").select("pid")


def _group_members(spark, d):
    groups, particles = group_lists(spark, d)
    return L.group_members(groups, particles, groups)


@query
def group_members(spark, d):
    return _group_members(spark, d).select("halo_id", *bigint("member_rank"), "pid", "bound")


@query
def subhalo_members_by_type(spark, d):
    return L.members_by_type(*typed_lists(spark, d)).select("sub_id", *bigint("ptype", "member_rank"), "pid")


@query
def region_fof(spark, d):
    return S.particles_in_region(load(spark, d, "particles"), region="FOF", members=_group_members(spark, d)).select("pid", *bigint("ptype"))


@query
def field_halos(spark, d):
    return rounded(S.field_halos(load(spark, d, "halos")).select("halo_id", "m200"), m200=6)


@query
def nth_parent_halo(spark, d):
    return S.nth_parent_halo(load(spark, d, "halos").select("row_id", "halo_id", "host_id"), 5, none=-1).select("halo_id")


@query
def parent_halo_count(spark, d):
    return S.parent_halos(load(spark, d, "halos"), none=-1).agg(F.count("*").alias("n"))


# Joins ---------------------------------------------------------------------------------------------------------------


@query
def node_lookup(spark, d):
    nodes = load(spark, d, "nodes")
    wanted = nodes.selectExpr("snapnum - 2 as snapnum", "tree_id")
    return rounded(T.lookup(nodes, wanted, ["snapnum", "tree_id"]).select("tree_id", *bigint("snapnum"), "node_id", "mass"), mass=6)


@query
def progenitor_self_join(spark, d):
    nodes = load(spark, d, "nodes").select("tree_id", "node_id", "main_prog", "mass")
    prog = nodes.select("tree_id", F.col("node_id").alias("main_prog"), F.col("mass").alias("prog_mass"))
    return rounded(nodes.join(prog, ["tree_id", "main_prog"]).select("tree_id", "node_id", "main_prog", "prog_mass"), prog_mass=6)


@query
def halo_ball_join(spark, d):
    p, h = load(spark, d, "particles").select("pid", "x", "y", "z"), load(spark, d, "halos").select("halo_id", "x", "y", "z", "r200")
    return rounded(X.ball_join(p, h, BOX).select(F.col("c_halo_id").alias("halo_id"), "pid", "r"), r=8)


@query
def halo_center_of_mass(spark, d):
    return rounded(X.centres_of_mass(load(spark, d, "particles"), load(spark, d, "halos"), BOX), m200=6, x=7, y=7, z=7)


@query
def substructure_geometric(spark, d):
    return X.substructure_within(load(spark, d, "halos"), BOX)


@query
def subhalos_in_r200(spark, d):
    return rounded(X.subhalos_within(load(spark, d, "subhalos"), load(spark, d, "halos"), BOX), r=8)


@query
def substructure_file(spark, d):
    listed = load(spark, d, "halos").where("host_id <> -1").selectExpr("host_id", "halo_id as sub_id")
    return S.substructure_of(listed, 40)


def _trees(spark, d):
    lengths = load(spark, d, "nodes").groupBy("tree_id").agg(F.count("*").alias("length"))
    return R.running_sum(lengths, "tree_id", "length", "start_offset")


@query
def tree_id_bounds(spark, d):
    return T.tree_bounds(_trees(spark, d)).select(*bigint("tree_id", "first", "last"))


@query
def tree_slice(spark, d):
    return T.slices(load(spark, d, "nodes"), _trees(spark, d)).select("tree_id", "node_id", *bigint("start_offset", "snapnum"))


@query
def tolerance_match(spark, d):
    nodes = load(spark, d, "nodes").select("node_id", "scale_factor")
    groups = load(spark, d, "halos").selectExpr("halo_id", "cast(1 as double) / (cast(1 as double) + cast(halo_id as double) / cast(8 as double)) as group_a")
    return X.epochs_matched(nodes, groups, "scale_factor", "group_a", 1e-4).select("node_id", "halo_id")


@query
def group_to_tree_index(spark, d):
    groups = load(spark, d, "halos").selectExpr("halo_id as group_id", "halo_id * 10 + 1 as first_sub")
    nodes = load(spark, d, "nodes").selectExpr("tree_id", "node_id", "snapnum", "tree_id * 10 + 1 as subhalo_nr")
    return T.first_subhalo_nodes(groups, nodes, SNAP)


# Profiles and histograms ---------------------------------------------------------------------------------------------


@query
def radial_bins_log(spark, d):
    rows = P.with_radius(load(spark, d, "particles"), MIDDLE)
    return P.radial_bins(rows, (1.0, 50.0), 10, "log")[0].select("pid", *bigint("bin"))


@query
def radial_bins_linear(spark, d):
    rows = P.with_radius(load(spark, d, "particles"), MIDDLE)
    return P.radial_bins(rows, (1.0, 50.0), 10, "linear")[0].select("pid", *bigint("bin"))


@query
def spherical_bin(spark, d):
    return P.radial_bins(P.with_radius(load(spark, d, "particles")), (5.0, 120.0), 12, "log")[0].select("pid", *bigint("bin"))


@query
def radial_profile(spark, d):
    rows, edges = P.radial_bins(P.with_radius(load(spark, d, "particles"), MIDDLE), (8.0, 50.0), 10)
    return rounded(P.radial_profile(rows, edges, "mass").select(*bigint("bin"), "r_mean", "density", "median"), r_mean=7, density=7, median=6)


@query
def mass_density_profile(spark, d):
    found = P.mass_density_profile(load(spark, d, "particles"), EDGE, 40.0, BOX, (8.0, 40.0), 10)
    return rounded(found.select(*bigint("bin"), "r_mean", "density"), r_mean=7, density=7)


@query
def mass_median_profile(spark, d):
    found = P.mass_density_profile(load(spark, d, "particles"), EDGE, 40.0, BOX, (8.0, 40.0), 10, average=False)
    return rounded(found.select(*bigint("bin"), "r_mean", "median_mass"), r_mean=7, median_mass=6)


@query
def gas_profile(spark, d):
    found = P.gas_profile(load(spark, d, "particles").where("ptype = 0"), EDGE, BOX, (10.0, 50.0), 8)
    return rounded(found.select(*bigint("bin"), "r_mean", "rho", "u"), r_mean=7, rho=7, u=7)


@query
def gas_median_profile(spark, d):
    found = P.gas_profile(load(spark, d, "particles").where("ptype = 0"), EDGE, BOX, (10.0, 50.0), 8, average=False)
    return rounded(found.select(*bigint("bin"), "r_mean", "rho", "u"), r_mean=7, rho=7, u=7)


@query
def kinematic_profile(spark, d):
    found = P.kinematic_profile(load(spark, d, "particles"), EDGE, (10.0, -20.0, 5.0), 40.0, BOX, (8.0, 40.0), 8)
    return rounded(found.select(*bigint("bin"), "r_mean", "vr_mean", "sigma_r", "sigma"), r_mean=6, vr_mean=6, sigma_r=6, sigma=6)


@query
def kinematic_profile_raw(spark, d):
    rows = load(spark, d, "particles").withColumns({c: F.col(c) - 50.0 for c in ("x", "y", "z")})
    found = P.kinematic_profile_raw(rows, (10.0, 60.0), 8, "linear")
    return rounded(found.select(*bigint("bin"), "r_mean", "vr_mean", "sigma_r", "sigma"), r_mean=6, vr_mean=6, sigma_r=6, sigma=6)


@query
def histogram_equal_width(spark, d):
    return rounded(P.histogram(load(spark, d, "particles"), "mass", 20).select(*bigint("bin"), "low", "high", "n"), low=6, high=6)


@query
def halo_mass_function(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_totalprice as m200")
    return rounded(P.mass_function(orders, BOX).select(*bigint("bin"), "log_mass", "n", "log_density"), log_mass=7, log_density=7)


# Grids ---------------------------------------------------------------------------------------------------------------


def _cells(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select(*bigint(*names), "value"), value=5)


def _cic(spark, d):
    return G.smooth_to_grid(load(spark, d, "particles"), "mass", SHAPE, LIMITS, "CIC")


@query
def grid_ngp(spark, d):
    return _cells(G.smooth_to_grid(load(spark, d, "particles"), "mass", SHAPE, LIMITS, "NGP"), *G.CELL)


@query
def grid_cic(spark, d):
    return _cells(_cic(spark, d), *G.CELL)


@query
def grid_gaussian(spark, d):
    return _cells(G.smooth_to_grid(load(spark, d, "particles"), "mass", SHAPE, LIMITS, "gaussian", sigma=1.0), *G.CELL)


@query
def grid_filter_sigma(spark, d):
    return _cells(G.smooth_to_grid(load(spark, d, "particles"), "mass", SHAPE, LIMITS, "NGP", filter_sigma=0.8), *G.CELL)


@query
def grid_slice_mean(spark, d):
    return _cells(G.grid_slice(_cic(spark, d), SHAPE, "z", width=3), "ix", "iy")


@query
def grid_slice_sum(spark, d):
    return _cells(G.grid_slice(_cic(spark, d), SHAPE, "y", index=0, width=4, average=False), "ix", "iz")


@query
def grid_projection_mean(spark, d):
    return _cells(G.grid_projection(_cic(spark, d), SHAPE, "z", "mean"), "ix", "iy")


@query
def grid_projection_sum(spark, d):
    return _cells(G.grid_projection(_cic(spark, d), SHAPE, "x", "sum"), "iy", "iz")


@query
def grid_projection_max(spark, d):
    return _cells(G.grid_projection(_cic(spark, d), SHAPE, "y", "max"), "ix", "iz")


@query
def grid_three_projections(spark, d):
    return rounded(G.three_planes(_cic(spark, d), SHAPE).select("plane", *bigint("i", "j"), "value"), value=5)


# Trees ---------------------------------------------------------------------------------------------------------------


@query
def main_progenitor_track(spark, d):
    found = T.branches(load(spark, d, "nodes"))
    return rounded(found.select("tree_id", "root_id", *bigint("depth", "snapnum"), "node_id", "redshift", "mass", "m200"), redshift=9, mass=6, m200=4)


@query
def main_progenitor_track_snap(spark, d):
    """Nodes as a TreeFrog file has them: known by snapshot and id, without trees."""
    progs = "case when main_prog = -1 then snapnum else snapnum - 1 end as prog_snap"
    nodes = load(spark, d, "nodes").selectExpr("*", "main_prog as prog", progs, f"{LAST_SNAP} + 1 - count(*) over (partition by tree_id) as root_tail_snap", "case when tree_id % 4 = 0 then -1 else fof_id end as host_id")
    found = T.branches_by_snapshot(nodes.drop("tree_id", "fof_id", "main_prog"))
    return rounded(found.select("root_id", *bigint("root_snap", "depth", "snapnum"), "node_id", "mass"), mass=6)


@query
def first_progenitor_track(spark, d):
    found = T.next_masses(T.branches(load(spark, d, "nodes"), include_terminal=True)).where("main_prog <> -1")
    return rounded(found.select("tree_id", "node_id", "redshift", "next_mass"), redshift=9, next_mass=6)


@query
def first_progenitor_chain(spark, d):
    first = load(spark, d, "nodes").where("main_prog <> -1").selectExpr("node_id as desc_id", "0 as prog_rank", "main_prog as prog_id")
    further = first.where("desc_id % 3 = 0").selectExpr("desc_id", "1 as prog_rank", "prog_id + 100000000 as prog_id")
    return T.link_chains(first.unionByName(further)).select("root_id", *bigint("depth"), "node_id")


@query
def main_branch_length(spark, d):
    return T.branch_lengths(load(spark, d, "nodes"))


def _statistics(spark, d):
    return T.assembly_of_trees(load(spark, d, "nodes"))


@query
def formation_redshift(spark, d):
    return rounded(_statistics(spark, d).select("tree_id", "zform"), zform=7)


@query
def mass_growth_alpha(spark, d):
    return rounded(_statistics(spark, d).select("tree_id", "alpha"), alpha=7)


@query
def recent_accretion(spark, d):
    return rounded(_statistics(spark, d).select("tree_id", "dm_over_m"), dm_over_m=7)


def _population(spark, d):
    nodes, halos = load(spark, d, "nodes"), S.field_halos(load(spark, d, "halos"))
    of_field = nodes.join(halos.select(F.col("halo_id").alias("tree_id")), "tree_id", "left_semi").select(nodes.columns)
    return T.assembly_of_trees(of_field).where("n_nodes > 5")


@query
def population_formation(spark, d):
    found = _population(spark, d).select("tree_id", "root_id", "n_nodes", "m0", "zform", "alpha", "dm_over_m")
    return rounded(found, m0=4, zform=7, alpha=7, dm_over_m=7)


@query
def hexbin_mass_zform(spark, d):
    points = _population(spark, d).where("n_nodes > 10").select(F.log10("m0").alias("lm"), "zform")
    return P.hexbin(points, "lm", "zform", 16)


def _fof(spark, d):
    """Trees are the FOF groups here, four customers' orders together; at each snapshot a list links them, not in the order of
    their ids, and the next of a list is the next progenitor as well."""
    nodes = load(spark, d, "nodes").selectExpr("*", FIRST_IN_FOF, NEXT_IN_FOF)
    return nodes.withColumns({"member": F.col("tree_id"), "tree_id": F.col("fof_id"), "next_prog": F.col("next_in_fof")})


def _written(nodes: DataFrame) -> DataFrame:
    """What orbits need of nodes, as they read them several times; of nodes with the same id the first row of the table counts."""
    return materialize(nodes.select(*T.ORBIT_COLUMNS, "first_in_fof", "next_in_fof"), "nodes")


@query
def fof_members(spark, d):
    found = T.fof_members(_fof(spark, d))
    return found.select("tree_id", "first_in_fof", *bigint("rank"), "node_id", "last")


@query
def fof_orbits(spark, d):
    found = T.fof_orbits(_written(_fof(spark, d)), BOX)
    keys = ("dx", "dy", "dz", "dvx", "dvy", "dvz", "mass")
    return rounded(found.select(F.col("tree_id").alias("fof_id"), "root_id", *bigint("snapnum"), *keys), **dict.fromkeys(keys, 6))


@query
def orbit_relative(spark, d):
    found = T.fof_orbits(_written(_fof(spark, d)), BOX, corrected=True)
    return rounded(found.select("root_id", *bigint("snapnum"), "dx", "dy", "dz"), dx=6, dy=6, dz=6)


@query
def orbit_radius(spark, d):
    nodes = _fof(spark, d)
    nodes = _written(nodes)
    orbits = T.fof_orbits(nodes, BOX).select(F.col("tree_id").alias("fof_id"), "root_id", "snapnum", "scale_factor", "r")
    own = nodes.select("tree_id", "node_id", "main_prog", "snapnum", "scale_factor", "mass")
    central = T.branches(own, nodes.where(f"snapnum = {LAST_SNAP} and first_in_fof = node_id")).select(F.col("tree_id").alias("fof_id"), "snapnum", "mass", "scale_factor")
    virial = T.r200_track(central, OMEGA0, OMEGA_LAMBDA).select("fof_id", "snapnum", "r200")
    return rounded(orbits.join(virial, ["fof_id", "snapnum"]).select("fof_id", "root_id", *bigint("snapnum"), "scale_factor", "r", "r200"), scale_factor=9, r=6, r200=6)


@query
def r200_track(spark, d):
    found = T.r200_track(T.branches(load(spark, d, "nodes")), OMEGA0, OMEGA_LAMBDA)
    return rounded(found.select("node_id", "r200"), r200=7)


@query
def merger_tree_edges(spark, d):
    found = T.tree_edges(_fof(spark, d), min_snap=55)
    return rounded(found.select("tree_id", "src", "dst", *bigint("src_snap", "dst_snap"), "x"), x=6)


@query
def halo_scatter(spark, d):
    """Particles about the centre of one halo, and its FOF group's satellites at the halo's epoch, matched by scale factor."""
    halo = load(spark, d, "halos").where("halo_id = 40").selectExpr("x as hx", "y as hy", "z as hz", "r200")
    p = load(spark, d, "particles").select("pid", "x", "y", "z").crossJoin(F.broadcast(halo))  # one halo
    near = p.select("pid", *[wrap(F.col(c) - F.col(f"h{c}"), BOX).alias(f"d{c}") for c in "xyz"], "r200").where("dx * dx + dy * dy + dz * dz < r200 * r200")
    parts = near.select(F.lit("particle").alias("kind"), F.col("pid").alias("id"), "dx", "dy", "dz")
    orbits = T.fof_orbits(_written(_fof(spark, d).where("tree_id = 40")), BOX).select("root_id", "scale_factor", "dx", "dy", "dz")
    epoch = spark.createDataFrame([(1.0,)], "group_a double")
    subs = X.tolerance_join(orbits, epoch, "scale_factor", "group_a", 1e-4).select(F.lit("subhalo").alias("kind"), F.col("root_id").alias("id"), "dx", "dy", "dz")
    return rounded(parts.unionByName(subs), dx=6, dy=6, dz=6)
