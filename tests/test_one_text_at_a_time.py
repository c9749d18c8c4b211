"""Texts of a batch become strings one at a time."""

import zlib

import pyarrow as pa

from tallyglass.functions.text import zlib_ratio
from tallyglass.operators import lookup


class Shared:
    value = ["needle"]


class Batch:
    """A batch whose columns can't be made lists as a whole."""

    def __init__(self, columns):
        self.columns = columns

    def column(self, name):
        return self.columns[name] if name != "_text" else Once(self.columns[name])


class Once:
    def __init__(self, cells):
        self.cells = cells

    def __iter__(self):
        return iter(self.cells)

    def to_pylist(self):
        raise AssertionError("a whole batch of texts as strings")


def test_lookup_reads_text_by_text():
    batch = Batch({"id": pa.array([1, 2, 3]), "_text": pa.array(["a needle", None, "hay"])})
    out = list(lookup._scan(Shared, "id", "v")([batch]))
    assert out[0].to_pydict() == {"id": [1], "v": ["needle"]}


def test_compressed_share_of_arrow_texts():
    got = zlib_ratio.func(pa.array(["ä" * 50, "", None])).to_pylist()
    assert got == [len(zlib.compress(("ä" * 50).encode())) / 100, None, None]
