"""Readers and writers: binary snapshots, text catalogues, HDF5 where h5py is there, and Parquet."""
