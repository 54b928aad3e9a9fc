"""SQL twins of the registered queries, over the same stand-in entities, written independently of the operators: nothing of theirs is imported but the entities."""

from __future__ import annotations

import math

from haloforge.plans.standins import FIRST_IN_FOF, IS_BOUND, MEMBERS, NEXT_IN_FOF, OMEGA0, OMEGA_LAMBDA, PARTICLES, cte

SQL: dict[str, str] = {}
NAN = "'nan'::double"


#: Edges of bins as literals: equal steps of the logarithm or of the value, both ends included.
_LOG_1_50_10 = [1.0, 1.544452104946379, 2.385332304473301, 3.6840314986403864, 5.689810202763908, 8.7876393444041, 13.572088082974531, 20.96144000826768, 32.37394014347626, 49.99999999999999]
_LOG_5_120_12 = [5.000000000000001, 6.674884474938244, 8.910816550754317, 11.895734210730547, 15.880530320239414, 21.20014105767042, 28.301698482469014, 37.78211356300313, 50.438248650408674, 67.33389657193753, 89.88919617302464, 119.99999999999996]
_LOG_8_50_10 = [7.999999999999999, 9.806659584425528, 12.021321525600634, 14.736125994561549, 18.064021402733644, 22.143463577798215, 27.144176165949066, 33.274211919892416, 40.78860865480238, 49.99999999999999]
_LOG_8_40_10 = [7.999999999999999, 9.566505396003215, 11.439753186469831, 13.679807573413576, 16.358494120918326, 19.561702784781502, 23.392141905702932, 27.972631470622517, 33.450041238014954, 40.000000000000014]
_LOG_8_40_8 = [7.999999999999999, 10.067991605134612, 12.670556870132636, 15.945882525109509, 20.067876424908157, 25.255401422356766, 31.783896188074102, 40.000000000000014]
_LINEAR_1_50_10 = [1.0, 6.444444444444445, 11.88888888888889, 17.333333333333332, 22.77777777777778, 28.22222222222222, 33.666666666666664, 39.111111111111114, 44.55555555555556, 50.0]
_LINEAR_10_50_8 = [10.0, 15.714285714285715, 21.42857142857143, 27.142857142857142, 32.85714285714286, 38.57142857142857, 44.285714285714285, 50.0]
_LINEAR_10_60_8 = [10.0, 17.142857142857142, 24.285714285714285, 31.428571428571427, 38.57142857142857, 45.714285714285715, 52.857142857142854, 60.0]


def d(v: float) -> str:
    """A double literal."""
    return f"{v!r}::double" if v == v else NAN


def add(name: str, body: str, *ctes: str, recursive: bool = False) -> None:
    head = ",\n".join(ctes)
    SQL[name] = (f"WITH {'RECURSIVE ' * recursive}{head}\n" if head else "") + body.strip()


def wrap(v: str, box: str = "100.0::double") -> str:
    return f"(case when {v} > {box} * 0.5 then {v} - {box} when {v} < -({box} * 0.5) then {v} + {box} else {v} end)"


def rnd(e: str, n: int) -> str:
    return f"round({e}, {n}) + 0.0::double"


def digits(r: str, edges: list[float]) -> str:
    return "(" + " + ".join(f"(case when {r} >= {d(e)} then 1 else 0 end)" for e in edges) + ")"


P, H, SUB, GAL, N = cte("particles"), cte("halos"), cte("subhalos"), cte("galaxies"), cte("nodes")
EDGE, MIDDLE, ORIGIN = (5.0, 50.0, 95.0), (50.0, 50.0, 50.0), (0.0, 0.0, 0.0)


def near(centre: tuple, periodic: bool, where: str = "true") -> str:
    """rows q: particles with dx, dy, dz, r about a centre."""
    parts = [wrap(f"({c} - {d(v)})") if periodic else f"({c} - {d(v)})" for c, v in zip("xyz", centre, strict=True)]
    return f"o as (select *, {parts[0]} as dx, {parts[1]} as dy, {parts[2]} as dz from particles where {where}),\nq as (select *, sqrt(dx * dx + dy * dy + dz * dz) as r from o)"


# Scans
add("positions_only_scan", "select x, y, z from particles", P)
add("hires_only_scan", "select pid, ptype::bigint as ptype from particles where ptype not in (2, 3, 7)", P)
add("mass_table_resolution", f"select pid, ptype::bigint as ptype, {rnd('case ptype when 1 then 1.5::double when 3 then 2.5::double else mass end', 6)} as mass from particles", P)
add("satellites_only", "select sub_id, group_id, sub_rank::bigint as sub_rank from subhalos where sub_rank <> 0", SUB)
add("load_by_type", "select pid, x, y, z, 0.0::double as potential from particles where ptype = 4", P)
add("type_counts", "select ptype::bigint as ptype, count(*) as n from particles group by ptype", P)
add("type_offsets", "select ptype::bigint as ptype, (sum(n) over (order by ptype) - n)::bigint as first, (sum(n) over (order by ptype))::bigint as last from (select ptype, count(*) as n from particles group by ptype)", P)
add("halo_members_explode", "select halo_id, k as member_rank, galaxies.row_id * 7 as pid from halos, range(3) t(k), galaxies where k < halo_id % 4 and galaxies.row_id = halo_id * 3 + k", H, GAL)

# Derived columns
add("periodic_wrap", "select pid, " + ", ".join(f"{rnd(wrap(f'({c} - {d(v)})'), 9)} as d{c}" for c, v in zip("xyz", EDGE, strict=True)) + " from particles", P)
add("unit_conversion", f"select pid, {', '.join(f'{rnd(f"{c} * 0.5::double * 0.7::double", 9)} as {c}' for c in 'xyz')}, {rnd('mass * 0.7::double', 6)} as mass, {rnd('100.0::double * 0.5::double * 0.7::double', 9)} as box_size from particles", P)
add("mesh_cell", "select pid, " + ", ".join(f"trunc(8 * ({c} - {d(o)}) / 80.0::double) + 0.0::double as c{c}" for c, o in zip("xyz", (10.0, 0.0, 50.0), strict=True)) + " from particles", P)
add("galaxy_totals", "select row_id, " + ", ".join(f"{rnd(f'{k}_disk + {k}_bulge', 6)} as {k}_tot" for k in ("mstar", "mgas", "matom")) + " from galaxies", GAL)
_FG, _D = 0.0491 / OMEGA0, (10.0 / OMEGA0 / 27.755) ** (1.0 / 3.0)
add("add_gas_particles", f"""
select row_number() over (order by pid, x, y, z, vx, vy, vz, mass, u, rho) - 1 as pid, 0::bigint as ptype, {', '.join(rnd(f'{c} - {d((1 - _FG) * 0.25 * _D)}', 7) + f' as {c}' for c in 'xyz')}, {rnd(f'mass * {d(_FG)}', 8)} as mass, 100.0::double as u from k where ptype = 1
union all
select pid + (select count(*) from k where ptype = 1), ptype::bigint, {', '.join(rnd(f'case when ptype = 1 then {c} - {d(0.25 * _D)} else {c} end', 7) for c in 'xyz')}, {rnd(f'case when ptype = 1 then mass * {d(1 - _FG)} else mass end', 8)}, {rnd('u', 6)} from k
""", P, "k as (select * from particles where ptype <> 0)")  # fmt: skip

# Selections
add("select_cubic", "select pid, x, y, z from q where abs(dx) < 15 and abs(dy) < 15 and abs(dz) < 15", P, near(EDGE, True))
add("select_spherical", "select pid, x, y, z from q where dx * dx + dy * dy + dz * dz < 225", P, near(EDGE, True))
add("select_with_ptype", "select pid, ptype::bigint as ptype from q where dx * dx + dy * dy + dz * dz < 225", P, near(EDGE, True))
add("region_sphere", "select pid from q where dx * dx + dy * dy + dz * dz <= 225", P, near(MIDDLE, False))
add("region_cuboid", "select pid from q where abs(dx) <= 10 and abs(dy) <= 15 and abs(dz) <= 20", P, near(MIDDLE, False))
add("region_fof", "select pid, ptype::bigint as ptype from particles where pid in (select pid from members)", P, MEMBERS)
add("group_members", f"""
select halo_id, row_number() over (partition by halo_id order by not bound, l_orderkey, l_linenumber, pid) - 1 as member_rank, pid, bound
from (select o_custkey as halo_id, {PARTICLES['pid']} as pid, {IS_BOUND} as bound, l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey)
""")  # fmt: skip
add("subhalo_members_by_type", f"""
select sub_id, ptype::bigint as ptype, row_number() over (partition by sub_id, ptype order by l_orderkey, l_linenumber, pid) - 1 as member_rank, pid
from (select l_suppkey as sub_id, {PARTICLES['ptype']} as ptype, {PARTICLES['pid']} as pid, l_orderkey, l_linenumber from lineitem)
""")  # fmt: skip
add("field_halos", f"select halo_id, {rnd('m200', 6)} as m200 from halos where structuretype = 10 and m200 > 0", H)
add("nth_parent_halo", "select halo_id from halos where host_id = -1 order by row_id limit 1 offset 5", H)
add("parent_halo_count", "select count(*) as n from halos where host_id = -1", H)

# Joins
add("node_lookup", f"select tree_id, snapnum::bigint as snapnum, node_id, {rnd('mass', 6)} as mass from nodes where (snapnum, tree_id) in (select (snapnum - 2, tree_id) from nodes)", N)
add("progenitor_self_join", f"select a.tree_id, a.node_id, a.main_prog, {rnd('b.mass', 6)} as prog_mass from nodes a join nodes b on b.tree_id = a.tree_id and b.node_id = a.main_prog", N)
_BALL = f"""ball as (select h.*, p.pid, p.x as px, p.y as py, p.z as pz, {wrap('(p.x - h.x)')} as dx, {wrap('(p.y - h.y)')} as dy, {wrap('(p.z - h.z)')} as dz
  from halos h join particles p on abs({wrap('(p.x - h.x)')}) < h.r200 and abs({wrap('(p.y - h.y)')}) < h.r200 and abs({wrap('(p.z - h.z)')}) < h.r200),
inside as (select *, sqrt(dx * dx + dy * dy + dz * dz) as r from ball where sqrt(dx * dx + dy * dy + dz * dz) < r200)"""
add("halo_ball_join", f"select halo_id, pid, {rnd('r', 8)} as r from inside", P, H, _BALL)
add("halo_center_of_mass", f"select halo_id, {rnd('m200', 6)} as m200, count(*) as n, {rnd('avg(px)', 7)} as x, {rnd('avg(py)', 7)} as y, {rnd('avg(pz)', 7)} as z from inside group by halo_id, m200", P, H, _BALL)


def _within(other: str, key: str) -> str:
    parts = [wrap(f"(s.{c} - h.{c})") for c in "xyz"]
    return f"w as (select h.halo_id, s.{key} as other_id, h.r200, sqrt({' + '.join(f'{p} * {p}' for p in parts)}) as r from halos h, {other} s)"


add("substructure_geometric", "select halo_id as host_id, other_id as sub_id from w where r < r200 and halo_id <> other_id", H, _within("halos", "halo_id"))
add("subhalos_in_r200", f"select halo_id, other_id as sub_id, {rnd('r', 8)} as r from w where r < r200", H, SUB, _within("subhalos", "sub_id"))
add("substructure_file", "select host_id, halo_id as sub_id from halos where host_id = 40 order by halo_id", H)
_OFF = "t as (select tree_id, count(*) as length from nodes group by tree_id),\nb as (select tree_id, length, (sum(length) over (order by tree_id) - length)::bigint as start_offset from t)"
add("tree_id_bounds", "select tree_id, start_offset as first, (start_offset + length)::bigint as last from b", N, _OFF)
add("tree_slice", "select k.tree_id, k.node_id, b.start_offset, k.snapnum::bigint as snapnum from (select *, row_number() over (order by tree_id, snapnum) - 1 as place from nodes) k join b on place >= b.start_offset and place < b.start_offset + b.length", N, _OFF)
add("tolerance_match", "select node_id, halo_id from nodes, halos where abs(scale_factor - 1.0::double / (1.0::double + halo_id::double / 8.0::double)) < 1e-4", N, H)
add("group_to_tree_index", "select halo_id as group_id, tree_id, node_id from halos join nodes on tree_id * 10 + 1 = halo_id * 10 + 1 where snapnum = 58", H, N)

# Profiles
add("radial_bins_log", f"select pid, {digits('r', _LOG_1_50_10)}::bigint as bin from q", P, near(MIDDLE, False))
add("radial_bins_linear", f"select pid, {digits('r', _LINEAR_1_50_10)}::bigint as bin from q", P, near(MIDDLE, False))
add("spherical_bin", f"select pid, {digits('r', _LOG_5_120_12)}::bigint as bin from q", P, near(ORIGIN, False))


def _profile(edges: list[float], aggregates: str, where: str = "true") -> str:
    shells = ", ".join(f"({k}, {d(low)}, {d(high)})" for k, (low, high) in enumerate(zip([0.0, *edges[:-1]], edges, strict=True)))
    return f"""v as (select bin, 4.0::double * pi() / 3.0::double * (high * high * high - low * low * low) as volume from (values {shells}) t(bin, low, high)),
b as (select *, {digits('r', edges)} as bin from q where {where}),
g as (select bin, avg(r) as r_mean, {aggregates} from b where bin < {len(edges)} group by bin)"""


_R = f"{rnd(f'coalesce(r_mean, {NAN})', 7)} as r_mean"
_RHO = "case when v.bin = 0 then 0.0::double else coalesce(total, 0.0::double) / volume end"
_BIN = "v.bin::bigint as bin"
add("radial_profile", f"select {_BIN}, {_R}, {rnd(_RHO, 7)} as density, {rnd(f'coalesce(middle, {NAN})', 6)} as median from v left join g on g.bin = v.bin", P, near(MIDDLE, False), _profile(_LOG_8_50_10, "sum(mass) as total, median(mass) as middle"))
_PROFILE = (P, near(EDGE, True), _profile(_LOG_8_40_10, "sum(mass) as total, median(mass) as middle", "dx * dx + dy * dy + dz * dz < 1600"))
add("mass_density_profile", f"select {_BIN}, {_R}, {rnd(_RHO, 7)} as density from v left join g on g.bin = v.bin", *_PROFILE)
add("mass_median_profile", f"select {_BIN}, {_R}, {rnd(f'coalesce(middle, {NAN})', 6)} as median_mass from v left join g on g.bin = v.bin", *_PROFILE)
add("gas_profile", f"select {_BIN}, {_R}, {rnd(_RHO, 7)} as rho, {rnd(_RHO.replace('total', 'total_u'), 7)} as u from v left join g on g.bin = v.bin", P, near(EDGE, True, "ptype = 0"), _profile(_LINEAR_10_50_8, "sum(rho) as total, sum(u) as total_u"))
add("gas_median_profile", f"select {_BIN}, {_R}, {rnd(f'coalesce(middle, {NAN})', 7)} as rho, {rnd(f'coalesce(middle_u, {NAN})', 7)} as u from v left join g on g.bin = v.bin", P, near(EDGE, True, "ptype = 0"), _profile(_LINEAR_10_50_8, "median(rho) as middle, median(u) as middle_u"))
_KIN = ", ".join(f"{rnd(f'coalesce({c}, {NAN})', 6)} as {c}" for c in ("r_mean", "vr_mean", "sigma_r", "sigma"))


def _kinematic(velocity: tuple) -> str:
    v = [f"({c} - {d(s)})" for c, s in zip(("vx", "vy", "vz"), velocity, strict=True)]
    vr = f"((dx * {v[0]} + dy * {v[1]} + dz * {v[2]}) / r)"
    return f"avg({vr}) as vr_mean, stddev_pop({vr}) as sigma_r, sqrt({' + '.join(f'var_pop({x})' for x in v)}) as sigma"


add("kinematic_profile", f"select {_BIN}, {_KIN} from v left join g on g.bin = v.bin", P, near(EDGE, True), _profile(_LOG_8_40_8, _kinematic((10.0, -20.0, 5.0)), "dx * dx + dy * dy + dz * dz < 1600"))
add("kinematic_profile_raw", f"select {_BIN}, {_KIN} from v left join g on g.bin = v.bin", P, near(MIDDLE, False), _profile(_LINEAR_10_60_8, _kinematic((0.0, 0.0, 0.0))))


def _histogram(source: str, value: str, n: int) -> str:
    return f"""m as (select {value} as v from {source}),
e as (select min(v) as lo, max(v) as hi, (max(v) - min(v)) / {n} as w from m),
c as (select least(floor((v - lo) / w), {n - 1})::bigint as bin, count(*) as n from m, e group by 1),
h as (select k as bin, lo + k * w as low, lo + (k + 1) * w as high, coalesce(c.n, 0) as n from range({n}) t(k) cross join e left join c on c.bin = k)"""


add("histogram_equal_width", f"select bin::bigint as bin, {rnd('low', 6)} as low, {rnd('high', 6)} as high, n from h", P, _histogram("particles", "mass", 20))
_DENSITY = "case when n > 0 then log10(n / 1000000.0::double / (select max(log10(o_totalprice)) - min(log10(o_totalprice)) / 10 from orders)) else '-inf'::double end"
add("halo_mass_function", f"select bin::bigint as bin, {rnd('0.5::double * (low + high)', 7)} as log_mass, n, {rnd(_DENSITY, 7)} as log_density from h", _histogram("orders", "log10(o_totalprice) + 10", 10))

# Grids
_UNIT = "c as (select x / 6.25::double as gx, y / 6.25::double as gy, z / 6.25::double as gz, mass as v from particles)"
_NGP = f"{_UNIT},\ngrid as (select floor(gx)::int as ix, floor(gy)::int as iy, floor(gz)::int as iz, sum(v) as value from c where gx >= 0 and gx < 16 and gy >= 0 and gy < 16 and gz >= 0 and gz < 16 group by 1, 2, 3)"


def _share(g: str, s: str) -> str:
    return f"(case when {s} = 1 then {g} - floor({g}) else 1 - ({g} - floor({g})) end)"


_CIC = f"""{_UNIT},
grid as (select (floor(gx)::int + a) % 16 as ix, (floor(gy)::int + b) % 16 as iy, (floor(gz)::int + e) % 16 as iz,
  sum(v * {_share('gx', 'a')} * {_share('gy', 'b')} * {_share('gz', 'e')}) as value
  from c, (values (0), (1)) ta(a), (values (0), (1)) tb(b), (values (0), (1)) te(e) group by 1, 2, 3)"""


def _filter(sigma: float) -> str:
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    rows = ", ".join(f"({o}, {d(w / sum(raw))})" for o, w in zip(range(-radius, radius + 1), raw, strict=True))
    out, last = [f"kernel as (select * from (values {rows}) t(o, w))"], "grid"
    for axis in ("ix", "iy", "iz"):
        to = f"(case when {axis} + o < 0 then -({axis} + o) - 1 when {axis} + o >= 16 then 31 - ({axis} + o) else {axis} + o end)"
        keys = ", ".join(f"{to} as {a}" if a == axis else a for a in ("ix", "iy", "iz"))
        out.append(f"f{axis} as (select {keys}, sum(value * w) as value from {last}, kernel group by 1, 2, 3)")
        last = f"f{axis}"
    return ",\n".join(out)


_ALL = f"select ix::bigint as ix, iy::bigint as iy, iz::bigint as iz, {rnd('value', 5)} as value from "
add("grid_ngp", _ALL + "grid", P, _NGP)
add("grid_cic", _ALL + "grid", P, _CIC)
add("grid_gaussian", _ALL + "fiz", P, _CIC, _filter(1.0))
add("grid_filter_sigma", _ALL + "fiz", P, _NGP, _filter(0.8))


def _image(a: str, b: str, value: str, where: str = "true") -> str:
    return f"select i::bigint as {a}, j::bigint as {b}, {rnd(value, 5)} as value from range(16) ti(i), range(16) tj(j) left join (select {a}, {b}, sum(value) as s, max(value) as m, count(*) as k from grid where {where} group by 1, 2) g on g.{a} = i and g.{b} = j"


_S = "coalesce(s, 0.0::double)"
add("grid_slice_mean", _image("ix", "iy", f"{_S} / 3", "iz between 7 and 9"), P, _CIC)
add("grid_slice_sum", _image("ix", "iz", _S, "iy between 0 and 2"), P, _CIC)
add("grid_projection_mean", _image("ix", "iy", f"{_S} / 16"), P, _CIC)
add("grid_projection_sum", _image("iy", "iz", _S), P, _CIC)
add("grid_projection_max", _image("ix", "iz", "case when coalesce(k, 0) < 16 then greatest(coalesce(m, 0.0::double), 0.0::double) else m end"), P, _CIC)
_PLANE = "select '{}' as plane, i, j, value from ({}) t(i, j, value)"
add("grid_three_projections", "\nunion all ".join(_PLANE.format(p, _image(a, b, _S, f"{c} = 8")) for p, a, b, c in (("xy", "ix", "iy", "iz"), ("xz", "ix", "iz", "iy"), ("yz", "iy", "iz", "ix"))), P, _CIC)

# Trees
_TRACK = """walk as (
  select tree_id, node_id as root_id, 0 as depth, node_id, main_prog from nodes n where not exists (select 1 from nodes m where m.main_prog = n.node_id and m.tree_id = n.tree_id)
  union all select w.tree_id, w.root_id, w.depth + 1, n.node_id, n.main_prog from walk w join nodes n on n.node_id = w.main_prog and n.tree_id = w.tree_id
),
track as (select w.root_id, w.depth, n.* from walk w join nodes n on n.node_id = w.node_id where n.main_prog <> -1)"""
add("main_progenitor_track", f"select tree_id, root_id, depth::bigint as depth, snapnum::bigint as snapnum, node_id, {rnd('redshift', 9)} as redshift, {rnd('mass', 6)} as mass, {rnd('m200', 4)} as m200 from track", N, _TRACK, recursive=True)
add("main_progenitor_track_snap", f"""
select root_id, root_snap::bigint as root_snap, depth::bigint as depth, snapnum::bigint as snapnum, node_id, {rnd('mass', 6)} as mass from hop where snapnum > tail
""", N, """known as (select *, main_prog as prog, snapnum - 1 as prog_snap, min(snapnum) over (partition by tree_id) as tail from nodes),
hop as (
  select node_id as root_id, snapnum as root_snap, 0 as depth, snapnum, node_id, prog, prog_snap, mass, tail from known k where tree_id % 4 = 0 and not exists (select 1 from known m where m.prog = k.node_id and m.prog_snap = k.snapnum)
  union all select h.root_id, h.root_snap, h.depth + 1, k.snapnum, k.node_id, k.prog, k.prog_snap, k.mass, h.tail from hop h join known k on k.snapnum = h.prog_snap and k.node_id = h.prog
)""", recursive=True)  # fmt: skip
add("first_progenitor_track", f"select a.tree_id, a.node_id, {rnd('a.redshift', 9)} as redshift, {rnd('b.mass', 6)} as next_mass from track a join nodes b on b.node_id = a.main_prog", N, _TRACK, recursive=True)
add("first_progenitor_chain", "select root_id, depth::bigint as depth, node_id from walk where exists (select 1 from nodes m where (m.node_id = walk.node_id and m.main_prog <> -1) or m.main_prog = walk.node_id)", N, _TRACK, recursive=True)
add("main_branch_length", "select tree_id, root_id, count(*) as n from track group by 1, 2", N, _TRACK, recursive=True)


def _interp(at: str, x: str, y: str, up: bool) -> str:
    """Clamped linear interpolation of (x, y) of one branch's rows, x strictly monotonic; up: x grows with depth."""
    lo_x, hi_x = f"max({x}) filter (where {x} <= {at})", f"min({x}) filter (where {x} > {at})"
    lo_y, hi_y = f"arg_max({y}, {x}) filter (where {x} <= {at})", f"arg_min({y}, {x}) filter (where {x} > {at})"
    return f"case when {lo_x} is null then {hi_y} when {hi_x} is null then {lo_y} else {lo_y} + ({at} - {lo_x}) * ({hi_y} - {lo_y}) / ({hi_x} - {lo_x}) end"


_STATS = f"""shares as (select *, m200 / max(m200) over (partition by root_id) as share from track),
stats as (select tree_id, root_id, count(*) as n_nodes, max(m200) as m0,
  case when count(*) > 10 then {_interp('0.5::double', 'share', 'redshift', False)} else 0.0::double end as zform,
  case when count(*) > 10 then -({_interp('3.0::double', 'redshift', 'ln(share)', True)}) / 3 else 0.0::double end as alpha,
  case when count(*) > 10 then 1 - exp({_interp('0.3::double', 'redshift', 'ln(share)', True)}) else 0.0::double end as dm_over_m
  from shares group by 1, 2)"""
for _name, _value in (("formation_redshift", "zform"), ("mass_growth_alpha", "alpha"), ("recent_accretion", "dm_over_m")):
    add(_name, f"select tree_id, {rnd(_value, 7)} as {_value} from stats", N, _TRACK, _STATS, recursive=True)
_POP = "pop as (select stats.* from stats join halos on halo_id = tree_id where structuretype = 10 and halos.m200 > 0 and n_nodes > 5)"
add("population_formation", f"select tree_id, root_id, n_nodes, {rnd('m0', 4)} as m0, {rnd('zform', 7)} as zform, {rnd('alpha', 7)} as alpha, {rnd('dm_over_m', 7)} as dm_over_m from pop", N, H, _TRACK, _STATS, _POP, recursive=True)
add("hexbin_mass_zform", """
select case when near then u1 else u2 + 0.5::double end as cx, case when near then v1 else v2 + 0.5::double end as cy, count(*) as n from (
  select *, pow(u - u1, 2) + 3 * pow(v - v1, 2) < pow(u - u2 - 0.5::double, 2) + 3 * pow(v - v2 - 0.5::double, 2) as near from (
    select u, v, floor(u + 0.5::double) as u1, floor(v + 0.5::double) as v1, floor(u) as u2, floor(v) as v2 from (
      select (x - min(x) over ()) / (case when max(x) over () > min(x) over () then max(x) over () - min(x) over () else 1 end) * 16 as u,
        (y - min(y) over ()) / (case when max(y) over () > min(y) over () then max(y) over () - min(y) over () else 1 end) * 9 as v
      from (select log10(m0) as x, zform as y from pop where n_nodes > 10)))) group by 1, 2
""", N, H, _TRACK, _STATS, _POP, recursive=True)  # fmt: skip
_LISTS = f"""fof as (select *, {FIRST_IN_FOF}, {NEXT_IN_FOF} from nodes),
list as (
  select fof_id, snapnum, node_id as first_in_fof, 0 as rank, node_id, next_in_fof from fof where node_id = first_in_fof
  union all select l.fof_id, l.snapnum, l.first_in_fof, l.rank + 1, f.node_id, f.next_in_fof from list l join fof f on f.fof_id = l.fof_id and f.node_id = l.next_in_fof
)"""
add("fof_members", "select fof_id as tree_id, first_in_fof, rank::bigint as rank, node_id, next_in_fof = -1 as last from list", N, _LISTS, recursive=True)

_FOF = f"""heads as (select fof_id, node_id, rank, next_in_fof = -1 as last from list where snapnum = 60),
own as (select t.fof_id, h.rank, h.last, t.root_id, t.snapnum, t.scale_factor, t.mass, {', '.join(f't.{c} * t.scale_factor as {c}' for c in 'xyz')}, {', '.join(f't.{c} * sqrt(t.scale_factor) as {c}' for c in ('vx', 'vy', 'vz'))} from track t join heads h on h.node_id = t.root_id),
orbits as (select s.fof_id, s.root_id, s.snapnum, s.scale_factor, s.mass, s.last, c.mass as central_mass, {', '.join(wrap(f'(s.{c} - c.{c})', '(100.0::double * s.scale_factor)') + f' as d{c}' for c in 'xyz')}, {', '.join(f's.{c} - c.{c} as d{c}' for c in ('vx', 'vy', 'vz'))}
  from own s join own c on c.fof_id = s.fof_id and c.snapnum = s.snapnum and c.rank = 0 where s.rank > 0)"""
add("fof_orbits", "select fof_id, root_id, snapnum::bigint as snapnum, " + ", ".join(f"{rnd(c, 6)} as {c}" for c in ("dx", "dy", "dz", "dvx", "dvy", "dvz", "mass")) + " from orbits where not last", N, _TRACK, _LISTS, _FOF, recursive=True)
add("orbit_relative", "select root_id, snapnum::bigint as snapnum, " + ", ".join(f"{rnd(c, 6)} as {c}" for c in ("dx", "dy", "dz")) + " from orbits", N, _TRACK, _LISTS, _FOF, recursive=True)


def _r200(mass: str, a: str) -> str:
    rho = f"(27.755::double * sqrt({d(OMEGA0)} / ({a} * {a} * {a}) + {d(OMEGA_LAMBDA)}))"
    return f"pow(3.0::double * {mass} / (4.0::double * pi()) / 200.0::double / {rho}, 1.0::double / 3.0::double) * {a}"


add("orbit_radius", f"select fof_id, root_id, snapnum::bigint as snapnum, {rnd('scale_factor', 9)} as scale_factor, {rnd('sqrt(dx * dx + dy * dy + dz * dz)', 6)} as r, {rnd(_r200('central_mass', 'scale_factor'), 6)} as r200 from orbits where not last", N, _TRACK, _LISTS, _FOF, recursive=True)
add("r200_track", f"select node_id, {rnd(_r200('mass', 'scale_factor'), 7)} as r200 from track", N, _TRACK, recursive=True)
add("merger_tree_edges", f"""
select fof_id as tree_id, node_id as src, main_prog as dst, src_snap, dst_snap, 0.0::double as x from steps
union all select s.fof_id, s.node_id, b.node_id, s.src_snap, b.snapnum, {rnd('b.rank * 0.1::double', 6)} from steps s join beside b on b.first = s.main_prog
""", N, _TRACK, _LISTS, """steps as (select t.fof_id, t.node_id, t.main_prog, t.snapnum::bigint as src_snap, n.snapnum::bigint as dst_snap from track t join nodes n on n.node_id = t.main_prog where t.depth = 0 or t.snapnum >= 55),
beside as (
  select f.node_id as first, 1 as rank, n.node_id, n.snapnum::bigint as snapnum, n.next_in_fof as after from fof f join fof n on n.node_id = f.next_in_fof
  union all select b.first, b.rank + 1, n.node_id, n.snapnum::bigint, n.next_in_fof from beside b join fof n on n.node_id = b.after
)""", recursive=True)  # fmt: skip
_D = [wrap(f"(p.{c} - h.{c})") for c in "xyz"]
add("halo_scatter", f"""
select 'particle' as kind, pid as id, {', '.join(f'{rnd(v, 6)} as d{c}' for c, v in zip('xyz', _D, strict=True))} from particles p, halos h where halo_id = 40 and {' + '.join(f'{v} * {v}' for v in _D)} < r200 * r200
union all select 'subhalo', root_id, {', '.join(rnd(f'd{c}', 6) for c in 'xyz')} from orbits where fof_id = 40 and not last and abs(scale_factor - 1) < 1e-4
""", P, H, N, _TRACK, _LISTS, _FOF, recursive=True)  # fmt: skip
