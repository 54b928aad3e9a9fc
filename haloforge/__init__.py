"""Analysis of cosmological simulation data on Spark: snapshots, halos, merger trees, profiles and grids."""
