"""Small helpers for functions that run over Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, so that no other column is read or clashes.  Keys are integers; text that spells one is
    read as it, and what can't be is null."""
    return docs.select(F.col(f"`{key}`").try_cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it: no column of ``docs`` is called so, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_blocks(batches: Iterable[pa.RecordBatch], at_most: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of consecutive rows of (key, text), about ``at_most`` characters together; null texts are empty."""
    keys: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = text or ""
                if texts and size + len(text) > at_most:
                    yield keys, texts
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text) + 1
    if texts:
        yield keys, texts


def frugal(run: Callable) -> Callable:
    """``run``, a generator over batches, after whose end free memory goes back to the system.  Workers live on from task to
    task; what the allocators of an idle one keep for later, often hundreds of MB, is missing beside it."""

    @functools.wraps(run)
    def frugally(*args):
        yield from run(*args)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):  # glibc
            libc.malloc_trim(0)

    return frugally
