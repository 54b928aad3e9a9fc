"""Files, groups, attributes and datasets as h5py shows them, kept as a pickle: for tests where h5py isn't installed."""

from __future__ import annotations

import os
import pickle

import numpy as np


class Dataset:
    def __init__(self, values):
        self.values, self.attrs = np.asarray(values), {}

    dtype = property(lambda self: self.values.dtype)
    shape = property(lambda self: self.values.shape)
    ndim = property(lambda self: self.values.ndim)

    def __len__(self):
        return len(self.values)

    def __getitem__(self, at):
        assert isinstance(at, slice), "rows are read by ranges"
        return self.values[at]

    def __setitem__(self, at, values):
        self.values[at] = values

    def resize(self, n, axis):
        grown = np.zeros((n, *self.values.shape[1:]), dtype=self.values.dtype)
        grown[: len(self.values)] = self.values
        self.values = grown


class VirtualSource:
    def __init__(self, path, name, shape):
        self.path, self.name, self.shape = path, name, shape


class VirtualLayout:
    def __init__(self, shape, dtype):
        self.shape, self.dtype, self.parts = shape, np.dtype(dtype), []

    def __setitem__(self, at, source):
        assert at.stop - at.start == source.shape[0], "a source has as many rows as its place"
        self.parts.append((at, source))


class VirtualDataset:
    """Rows of other files, looked up when they are read."""

    def __init__(self, layout, fill, path):
        self.layout, self.fill, self.path, self.attrs = layout, fill, path, {}

    dtype = property(lambda self: self.layout.dtype)
    shape = property(lambda self: self.layout.shape)
    ndim = property(lambda self: len(self.layout.shape))

    def __len__(self):
        return self.layout.shape[0]

    def __getitem__(self, at):
        values = np.full(self.layout.shape, self.fill, dtype=self.dtype)
        for place, source in self.layout.parts:
            with File(os.path.join(os.path.dirname(self.path), source.path)) as f:
                values[place] = f[source.name][:]
        return values[at]


class Group:
    def __init__(self, attrs=None, **held):
        self.attrs, self.held = attrs or {}, held

    def _at(self, path):
        here = self
        for name in [x for x in path.split("/") if x]:
            here = here.held[name] if isinstance(here, Group) and name in here.held else None
        return here

    def __contains__(self, path):
        return self._at(path) is not None

    def __getitem__(self, path):
        found = self._at(path)
        if found is None:
            raise KeyError(path)
        if isinstance(found, Dataset):
            File.touched.append(path)
        return found

    def __iter__(self):
        return iter(self.held)

    def values(self):
        return self.held.values()

    def create_group(self, name):
        self.held[name] = Group()
        return self.held[name]

    def create_virtual_dataset(self, name, layout, fillvalue):
        self.held[name] = VirtualDataset(layout, fillvalue, File.written)

    def create_dataset(self, name, shape, maxshape, dtype, chunks):
        self.held[name] = Dataset(np.zeros(shape, dtype=dtype))


class File(Group):
    #: Names of the datasets that were asked for.
    touched: list[str] = []
    written = ""

    def __init__(self, path, mode="r"):
        super().__init__()
        self.path, self.mode = path, mode
        if mode == "w":
            File.written = path
        if mode != "w":
            with open(path, "rb") as f:
                self.attrs, self.held = pickle.load(f)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.mode != "r":
            self.save()

    def save(self):
        with open(self.path, "wb") as f:
            pickle.dump((self.attrs, self.held), f)


def make(path, attrs=None, **held) -> str:
    """A file of groups, or of datasets given as lists."""
    f = File(str(path), "w")
    f.attrs, f.held = attrs or {}, {k: v if isinstance(v, Group) else Dataset(v) for k, v in held.items()}
    f.save()
    return str(path)


def group(attrs=None, **held) -> Group:
    return Group(attrs, **{k: v if isinstance(v, Group) else Dataset(v) for k, v in held.items()})
