"""Merger trees: branches, assembly statistics, orbits, edges.

Nodes are rows (tree_id, node_id, ...) with pointers to other nodes of their tree, -1 where there is none.  Most trees are
small and complete in themselves, so one shuffle and sort by tree_id brings all pointers of a walk together; a batch holds
many whole trees, whose branches are walked at once, a depth a step.  Trees of more than ``TREE_ROWS`` nodes, lists and
nodes that are known by snapshot and id are followed by pointer doubling (``links``), with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haloforge.cosmology import r200
from haloforge.functions.columns import wrap
from haloforge.operators.links import follow
from haloforge.operators.transform import running_sum
from haloforge.work import materialize

#: A tree of more nodes isn't brought to one task.
TREE_ROWS = 1 << 20


def _whole_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by tree_id -> frames of whole trees; the last tree of a batch waits for the next batch."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        ids = rows["tree_id"].to_numpy()
        cut = int(np.searchsorted(ids, ids[-1], side="left"))
        if cut or (held and held[-1]["tree_id"].iloc[-1] != ids[-1]):
            yield pd.concat([*held, rows.iloc[:cut]], ignore_index=True)
            held = []
        held.append(rows.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _by_tree(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema, *order: str) -> DataFrame:
    """``f`` over frames of many whole trees each: one shuffle and sort, and no call for every single tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for trees in _whole_trees(batches):
            yield f(trees)

    return rows.where("tree_id is not null").repartition("tree_id").sortWithinPartitions("tree_id", *order).mapInPandas(run, schema)


def _next_places(trees: np.ndarray, node: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where each row's pointer leads: a row of the same tree, or -1."""
    order = np.lexsort((node, trees))
    # Ranks of distinct (tree, node), and of the pointers among them.
    both = np.stack([np.concatenate([trees, trees]), np.concatenate([node, to])])
    sort = np.lexsort((both[1], both[0]))
    fresh = np.ones(len(sort), dtype=bool)
    fresh[1:] = (both[:, sort[1:]] != both[:, sort[:-1]]).any(axis=0)
    rank = np.empty(len(sort), dtype=np.int64)
    rank[sort] = np.cumsum(fresh) - 1
    place = np.full(len(sort), -1, dtype=np.int64)
    place[rank[: len(node)][order][::-1]] = order[::-1]
    return place[rank[len(node) :]]


def _walk(include_terminal: bool) -> Callable:
    """Rows with their pointer as ``__to`` -> root_id, depth and the other columns.  Branches start where ``__root`` says; without it, at
    rows that no pointer leads to."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        trees, node, to = (rows[c].to_numpy(dtype=np.int64) for c in ("tree_id", "node_id", "__to"))
        following = _next_places(trees, node, to)
        last = to == -1
        if "__root" in rows:
            starts = rows["__root"].to_numpy(dtype=bool)
        else:
            led = np.zeros(len(to), dtype=bool)
            led[following[~last & (following >= 0)]] = True
            starts = ~led[_next_places(trees, node, node)]  # rows of the same id are led to together
        following[last | (following == np.arange(len(to)))] = -1
        at = root = np.flatnonzero(starts)
        where, roots, depths, depth = [], [], [], 0
        while len(at):
            if depth > len(to):
                raise ValueError("pointers go round in a circle")
            kept = np.ones(len(at), dtype=bool) if include_terminal else ~last[at]
            where.append(at[kept])
            roots.append(root[kept])
            depths.append(np.full(int(kept.sum()), depth, dtype=np.int32))
            on = following[at] >= 0
            at, root, depth = following[at[on]], root[on], depth + 1
        rows = rows.drop(columns=["__root", "__to"], errors="ignore")
        where, roots, depths = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (where, roots, depths))
        out = rows.iloc[where].reset_index(drop=True)
        out.insert(0, "root_id", node[roots])
        out.insert(1, "depth", depths.astype(np.int32))
        return out

    return run


def _followed(marked: DataFrame, include_terminal: bool) -> DataFrame:
    """As ``_walk``, of trees of any size: no tree is brought to one task."""
    marked = materialize(marked, "nodes")
    key = F.struct("tree_id", "node_id")
    links = marked.select(key.alias("node"), F.when(F.col("__to") != -1, F.struct("tree_id", F.col("__to").alias("node_id"))).alias("to"))
    paths = follow(links, marked.where("__root").select(key.alias("node")))
    found = paths.select(F.col("root.node_id").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.col("node.tree_id").alias("tree_id"), F.col("node.node_id").alias("node_id"))
    met = found.join(marked if include_terminal else marked.where("__to <> -1"), ["tree_id", "node_id"])
    return met.select("root_id", "depth", *[c for c in marked.columns if c not in ("__root", "__to")])


def _over_trees(nodes: DataFrame, roots: DataFrame | None, pointer: str, include_terminal: bool, tree_rows: int | None, f: Callable | None = None, schema=None, whole: Callable | None = None) -> DataFrame:
    """Branches of all trees; or, of trees that fit in a task, ``f`` of a frame with many trees' branches, and of the others ``whole``."""
    to = F.coalesce(F.col(pointer).cast("long"), F.lit(-1)).alias("__to")
    walk = _walk(include_terminal)
    if f is None:
        schema = T.StructType([T.StructField("root_id", T.LongType()), T.StructField("depth", T.IntegerType()), *nodes.schema.fields])
        run, whole = walk, lambda found: found
    else:
        run = lambda rows: f(walk(rows))
    sizes = nodes.groupBy("tree_id").agg(F.count("*").alias("__size"))
    large = materialize(sizes.where(F.col("tree_id").isNull() | (F.col("__size") > (TREE_ROWS if tree_rows is None else tree_rows))), "large-trees")
    if large.isEmpty():
        return _by_tree(_marked(nodes, roots, to), run, schema)
    if not large.where("tree_id is null").isEmpty():
        raise ValueError("nodes without a tree_id: follow them by snapshot and id")
    small, others = (nodes.join(large, "tree_id", how).select(nodes.columns) for how in ("left_anti", "left_semi"))
    near = None if roots is None else roots.join(large, "tree_id", "left_anti")
    return _by_tree(_marked(small, near, to), run, schema).union(whole(_followed(_marked_apart(others, roots, to), include_terminal)))


def _marked(nodes: DataFrame, roots: DataFrame | None, to: Column) -> DataFrame:
    """Nodes dealt out by tree, with ``to``, and with ``__root`` if roots are given: their rows come beside the nodes', so the exchange of the walk is
    the only one (a join by tree and id would be another)."""
    if roots is None:
        return nodes.repartition("tree_id").select("*", to)
    given = roots.select("tree_id", "node_id").where("tree_id is not null and node_id is not null").distinct()
    rows = nodes.withColumn("__given", F.lit(False)).unionByName(given.withColumn("__given", F.lit(True)), allowMissingColumns=True)
    of_id = F.bool_or("__given").over(Window.partitionBy("tree_id", "node_id"))
    return rows.repartition("tree_id").withColumn("__root", of_id).where("not __given").select(*nodes.columns, "__root", to)


def _marked_apart(nodes: DataFrame, roots: DataFrame | None, to: Column) -> DataFrame:
    """Nodes with ``__root`` and ``to``, by joins whose keys have the id too: a large tree is dealt to many tasks."""
    rows = nodes.select("*", to)
    if roots is None:
        # Chain heads of the same pointer, within the tree.
        led_to = rows.select("tree_id", F.col("__to").alias("node_id")).where("node_id <> -1").distinct().withColumn("__led", F.lit(True))
        return rows.join(led_to, ["tree_id", "node_id"], "left").select(*nodes.columns, F.col("__led").isNull().alias("__root"), "__to")
    given = roots.select("tree_id", "node_id").distinct().withColumn("__given", F.lit(True))
    return rows.join(given, ["tree_id", "node_id"], "left").select(*nodes.columns, F.coalesce("__given", F.lit(False)).alias("__root"), "__to")


def branches(nodes: DataFrame, roots: DataFrame | None = None, pointer: str = "main_prog", include_terminal: bool = False, tree_rows: int | None = None) -> DataFrame:
    """root_id, depth and all columns of ``nodes``, for each node on the branch that starts at each root.

    roots (tree_id, node_id); by default the nodes that no pointer leads to.  The last node, whose pointer is -1 or null, is left out unless
    ``include_terminal``; a branch also ends where a pointer leads to no node.  Nodes without a tree_id raise a ``ValueError``
    (``branches_by_snapshot`` needs none).  Trees of more than ``tree_rows`` nodes are followed across tasks.
    """
    return _over_trees(nodes, roots, pointer, include_terminal, tree_rows)


def branches_by_snapshot(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """root_snap, root_id, depth and all columns of ``nodes``: branches of field halos along (prog_snap, prog), for as long as the
    snapshot is later than the root's root_tail_snap.  Nodes are known by snapnum and node_id and need no tree.

    roots (snapnum, node_id), of which those count that lie in no other halo (host_id -1); by default all such nodes that no
    progenitor pointer leads to.  A node that is its own progenitor has none.
    """
    nodes = materialize(nodes, "nodes")
    key, to = F.struct(F.col("snapnum").cast("long").alias("snapnum"), "node_id"), F.struct(F.col("prog_snap").cast("long").alias("snapnum"), F.col("prog").alias("node_id"))
    links = nodes.select(key.alias("node"), F.when((F.col("prog") != -1) & F.col("prog_snap").isNotNull(), to).alias("to"))
    field = nodes.where("host_id = -1").select(key.alias("node"))
    if roots is None:
        heads = field.join(links.where("to is not null and to <> node").select(F.col("to").alias("node")), "node", "left_anti")
    else:
        heads = field.join(roots.select(key.alias("node")), "node", "left_semi")
    paths = follow(links, heads)
    paths = paths.select(F.col("root.snapnum").alias("root_snap"), F.col("root.node_id").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.col("node.snapnum").alias("snapnum"), F.col("node.node_id").alias("node_id"))
    tails = nodes.select(F.col("snapnum").cast("long").alias("root_snap"), F.col("node_id").alias("root_id"), F.col("root_tail_snap").alias("__tail"))
    met = paths.join(tails, ["root_snap", "root_id"]).where(F.col("snapnum") > F.col("__tail")).drop("__tail")
    own = nodes.withColumn("__snap", F.col("snapnum").cast("long"))
    met = met.withColumnRenamed("snapnum", "__snap").join(own, ["__snap", "node_id"])
    return met.select(F.col("root_snap").cast("int").alias("root_snap"), "root_id", "depth", *nodes.columns)


def next_masses(track: DataFrame, mass: str = "mass") -> DataFrame:
    """With next_mass: the mass of the node that follows on the branch (for the last one, none)."""
    return track.withColumn("next_mass", F.lead(mass).over(Window.partitionBy("tree_id", "root_id").orderBy("depth")))


def link_chains(links: DataFrame) -> DataFrame:
    """links (desc_id, prog_rank, prog_id) -> root_id, depth, node_id: chains of first progenitors from every descendant
    that isn't itself the first progenitor of another."""
    first = materialize(links.where("prog_rank = 0").select("desc_id", "prog_id"), "first")
    nodes = first.select(F.col("desc_id").alias("node")).union(first.select("prog_id")).distinct()
    own = materialize(nodes.join(first.select(F.col("desc_id").alias("node"), F.col("prog_id").alias("to")), "node", "left"), "links")
    heads = first.select(F.col("desc_id").alias("node")).join(first.select(F.col("prog_id").alias("node")), "node", "left_anti")
    found = follow(own, heads)
    if not own.join(found.select("node"), "node", "left_anti").isEmpty():
        raise ValueError("pointers go round in a circle")  # what no head leads to is led to by itself
    return found.select(F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.col("node").alias("node_id"))


_STATISTICS = "tree_id long, root_id long, n_nodes long, m0 double, zform double, alpha double, dm_over_m double"


def _assembly(least: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        trees, roots, m200, redshift = (rows[c].to_numpy() for c in ("tree_id", "root_id", "m200", "redshift"))
        begin = np.flatnonzero(np.concatenate([[True], (trees[1:] != trees[:-1]) | (roots[1:] != roots[:-1])]))
        out = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(rows)], strict=True) if len(rows) else ():
            m, z = m200[a:b], redshift[a:b]
            zform = alpha = grown = 0.0
            if len(m) > least:
                share = m / m[0]
                zform = float(np.interp(0.5, share[::-1], z[::-1]))
                alpha = float(-np.interp(3.0, z, np.log(share)) / 3.0)
                grown = float(1.0 - np.exp(np.interp(0.3, z, np.log(share))))
            out.append((trees[a], roots[a], len(m), m[0], zform, alpha, grown))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _STATISTICS.split(", ")])

    return run


def assembly_statistics(track: DataFrame, least: int = 10) -> DataFrame:
    """tree_id, root_id, n_nodes, m0, zform, alpha, dm_over_m of each branch: the redshift at half the last mass, the slope
    of ln M up to redshift 3, and the share gained since 0.3.  0 for branches of ``least`` nodes or fewer."""
    return _by_tree(track.select("tree_id", "root_id", "depth", "m200", "redshift"), _assembly(least), _STATISTICS, "root_id", "depth")


def assembly_of_trees(nodes: DataFrame, roots: DataFrame | None = None, pointer: str = "main_prog", least: int = 10, tree_rows: int | None = None) -> DataFrame:
    """``assembly_statistics`` of ``branches``, in the pass that walks them: branches aren't moved again."""
    inside = _assembly(least)

    def f(found: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((found["depth"].to_numpy(), found["root_id"].to_numpy(), found["tree_id"].to_numpy()))
        return inside(found.iloc[order].reset_index(drop=True))

    own = nodes.select("tree_id", "node_id", pointer, "m200", "redshift")
    return _over_trees(own, roots, pointer, False, tree_rows, f, _STATISTICS, lambda found: assembly_statistics(found, least))


def fof_members(nodes: DataFrame, snapnum: int | None = None) -> DataFrame:
    """nodes (tree_id, node_id, first_in_fof, next_in_fof) -> tree_id, first_in_fof, rank, node_id, last: each group's members in the
    order of its list, from the first, of rank 0, on.  With ``snapnum`` the groups of that snapshot alone."""
    own = nodes if snapnum is None else nodes.where(F.col("snapnum") == snapnum)
    own = materialize(own.select("tree_id", "node_id", "first_in_fof", "next_in_fof"), "lists")  # for sizes, roots and the walk
    found = branches(own, own.select("tree_id", F.col("first_in_fof").alias("node_id")), "next_in_fof", include_terminal=True)
    return found.select("tree_id", F.col("root_id").alias("first_in_fof"), F.col("depth").alias("rank"), "node_id", (F.coalesce("next_in_fof", F.lit(-1)) == -1).alias("last"))


#: What ``fof_orbits`` reads of nodes, besides the groups' lists.
ORBIT_COLUMNS = ("tree_id", "node_id", "main_prog", "snapnum", "scale_factor", "mass", "x", "y", "z", "vx", "vy", "vz")


def fof_orbits(nodes: DataFrame, box: float, snapnum: int | None = None, corrected: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """Orbits of the members of a snapshot's FOF groups about the central one's branch, in physical units.

    Members are those that the groups' lists lead to (``fof_members``); by default of the last snapshot; groups (tree_id, first_in_fof):
    these alone.  The last of a list is left out, as users of the method have it, unless ``corrected``.  -> tree_id, first_in_fof,
    root_id, rank, depth, snapnum, scale_factor, dx, dy, dz, dvx, dvy, dvz, mass, r, v_r.  Nodes are read several times:
    a written table serves best, and of those with the same id its first row counts.
    """
    if snapnum is None:
        snapnum = nodes.agg(F.max("snapnum")).first()[0]
    members = fof_members(nodes, snapnum)
    if groups is not None:
        members = members.join(groups.select("tree_id", "first_in_fof").distinct(), ["tree_id", "first_in_fof"], "left_semi")
    used = materialize(members if corrected else members.where("rank = 0 or not last"), "members")
    track = branches(nodes.select(*ORBIT_COLUMNS), used).join(used.select("tree_id", F.col("node_id").alias("root_id"), "first_in_fof", "rank"), ["tree_id", "root_id"])
    a, group = F.col("scale_factor"), ["tree_id", "first_in_fof"]
    own = [(F.col(c) * a).alias(c) for c in ("x", "y", "z")] + [(F.col(c) * F.sqrt(a)).alias(c) for c in ("vx", "vy", "vz")]
    physical = materialize(track.select(*group, "root_id", "rank", "depth", "snapnum", "scale_factor", "mass", *own), "tracks")
    central = physical.where("rank = 0").select(*group, "snapnum", *[F.col(c).alias(f"c{c}") for c in ("x", "y", "z", "vx", "vy", "vz")])
    met = physical.where("rank > 0").join(central, [*group, "snapnum"])
    d = {f"d{c}": wrap(F.col(c) - F.col(f"c{c}"), F.lit(box) * a) for c in ("x", "y", "z")} | {f"d{c}": F.col(c) - F.col(f"c{c}") for c in ("vx", "vy", "vz")}
    met = met.withColumns(d).withColumn("r", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2))
    v_r = F.try_divide(F.col("dx") * F.col("dvx") + F.col("dy") * F.col("dvy") + F.col("dz") * F.col("dvz"), F.col("r"))
    return met.select(*group, "root_id", "rank", "depth", "snapnum", "scale_factor", "dx", "dy", "dz", "dvx", "dvy", "dvz", "mass", "r", v_r.alias("v_r"))


def r200_track(track: DataFrame, omega0: float, omega_lambda: float, factor: float = 1.0, mass: str = "mass", corrected: bool = False) -> DataFrame:
    """With r200 at each node's epoch, physical."""
    return track.withColumn("r200", r200(F.col(mass), F.col("scale_factor"), omega0, omega_lambda, factor, corrected))


def tree_bounds(trees: DataFrame) -> DataFrame:
    """trees (tree_id, start_offset, length) -> tree_id, first, last."""
    return trees.select("tree_id", F.col("start_offset").alias("first"), (F.col("start_offset") + F.col("length")).alias("last"))


def tree_edges(nodes: DataFrame, min_snap: int = 55, roots: DataFrame | None = None, pointer: str = "main_prog") -> DataFrame:
    """tree_id, src, dst, src_snap, dst_snap, x: edges from each main-branch node to its progenitor (x = 0) and to those that the
    list of next_prog leads to from there, in order (x = 0.1, 0.2, ...).

    The walk ends after the first edge to a snapshot before ``min_snap``.
    """
    nodes = materialize(nodes.select(*dict.fromkeys(("tree_id", "node_id", "snapnum", pointer, "next_prog"))), "nodes")
    snaps = nodes.select("tree_id", F.col("node_id").alias("dst"), F.col("snapnum").alias("dst_snap"))
    main = branches(nodes, roots, pointer)
    kept = main.where((F.col("depth") == 0) | (F.col("snapnum") >= min_snap))
    steps = kept.select("tree_id", F.col("node_id").alias("src"), F.col(pointer).alias("dst"), F.col("snapnum").alias("src_snap"))
    steps = materialize(steps.join(snaps, ["tree_id", "dst"]), "steps")
    aside = branches(nodes.select("tree_id", "node_id", "next_prog"), steps.select("tree_id", F.col("dst").alias("node_id")), "next_prog", include_terminal=True).where("depth > 0")
    aside = aside.select("tree_id", F.col("root_id").alias("dst"), F.col("node_id").alias("sibling"), (F.col("depth") * 0.1).alias("x"))
    further = steps.drop("dst_snap").join(aside, ["tree_id", "dst"]).select("tree_id", "src", F.col("sibling").alias("dst"), "src_snap", "x").join(snaps, ["tree_id", "dst"])
    columns = ["tree_id", "src", "dst", "src_snap", "dst_snap", "x"]
    return steps.withColumn("x", F.lit(0.0)).select(columns).union(further.select(columns))


def branch_lengths(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """tree_id, root_id, n: hops along the main branch."""
    return branches(nodes, roots).groupBy("tree_id", "root_id").agg(F.count("*").alias("n"))


def lookup(nodes: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Nodes at (snapshot, id) places: an equi-join; Spark broadcasts the smaller side if its size allows."""
    return nodes.join(wanted.select(*on).distinct(), on)


def slices(nodes: DataFrame, trees: DataFrame, per_range: int = 1000, per_bucket: int = 4096) -> DataFrame:
    """nodes with b_tree_id and start_offset of the tree whose range of places holds the node's place among all nodes by
    tree_id and snapnum.  trees: tree_id, start_offset, length.

    A node's place is a rank within ``per_range`` trees after a running sum over such ranges; places meet ranges in buckets of ``per_bucket``, so the
    join by range is an equi-join.
    """
    ranged = nodes.withColumn("__trees", F.floor(F.col("tree_id") / F.lit(per_range)))
    before = running_sum(ranged.groupBy("__trees").agg(F.count("*").alias("n")), "__trees", "n", "__upto").drop("n")
    inside = F.row_number().over(Window.partitionBy("__trees").orderBy("tree_id", "snapnum")) - 1
    placed = ranged.withColumn("__inside", inside).join(before, "__trees").withColumn("__place", F.col("__upto") + F.col("__inside"))
    placed = placed.withColumn("__bucket", F.floor(F.col("__place") / F.lit(per_bucket))).drop("__trees", "__upto", "__inside")
    last = F.col("start_offset") + F.col("length") - 1
    buckets = F.sequence(F.floor(F.col("start_offset") / F.lit(per_bucket)), F.floor(last / F.lit(per_bucket)))
    spread = trees.where("length > 0").select(F.col("tree_id").alias("b_tree_id"), "start_offset", last.alias("__last"), F.explode(buckets).alias("__bucket"))
    met = placed.join(spread, "__bucket").where((F.col("__place") >= F.col("start_offset")) & (F.col("__place") <= F.col("__last")))
    return met.drop("__bucket", "__place", "__last")


def first_subhalo_nodes(groups: DataFrame, nodes: DataFrame, snapnum: int) -> DataFrame:
    """groups (group_id, first_sub) -> group_id, tree_id, node_id of the first subhalo at a snapshot."""
    at = nodes.where(F.col("snapnum") == snapnum).select("tree_id", "node_id", "subhalo_nr")
    return groups.join(at, groups["first_sub"] == at["subhalo_nr"]).select("group_id", "tree_id", "node_id")
