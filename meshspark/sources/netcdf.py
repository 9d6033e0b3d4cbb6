"""Classic NetCDF files (format versions 1, 2 and 5) as a Spark data source.

    spark.dataSource.register(ClassicNetcdf)
    spark.read.format("netcdf_classic").option("variables", "lon,lat").load(path)

Only the header is read on the driver.  The variables named, which share their dimensions, are read in
slabs of the first dimension, a partition for each; other variables are never touched.  Rows are one
for each cell: its index in every dimension, under that dimension's name, and the values.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import cut

#: Fixed values of the format: type codes and what they stand for, big-endian.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
SLAB_BYTES = 64 << 20


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    kind: np.dtype
    begin: int
    record: bool  # whether the first dimension is the unlimited one
    slab: int  # bytes of one index of the first dimension in this variable
    stride: int  # bytes from one such index to the next


class _Header:
    """The header's fields one after the other."""

    def __init__(self, file):
        self.file = file
        magic = file.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.wide, self.offset = magic[3] == 5, ">q" if magic[3] in (2, 5) else ">i"

    def number(self, form: str = "") -> int:
        form = form or (">q" if self.wide else ">i")
        return struct.unpack(form, self.file.read(struct.calcsize(form)))[0]

    def padded(self, n: int) -> bytes:
        return self.file.read(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def attributes(self) -> None:
        self.number(">i")
        for _ in range(self.number()):
            self.name()
            kind = np.dtype(TYPES[self.number(">i")])
            self.padded(self.number() * kind.itemsize)


def variables_of(path: str) -> dict[str, Variable]:
    """What a file holds, from its header."""
    with open(local(path), "rb") as file:
        h = _Header(file)
        records = h.number()
        h.number(">i")
        dims = [(h.name(), h.number()) for _ in range(h.number())]
        h.attributes()
        h.number(">i")
        raw = []
        for _ in range(h.number()):
            name = h.name()
            ids = [h.number() for _ in range(h.number())]
            h.attributes()
            kind = np.dtype(TYPES[h.number(">i")])
            h.number()  # a size that may be capped; it follows from the shape
            raw.append((name, ids, kind, h.number(h.offset)))
        size = lambda ids, kind: math.prod(dims[i][1] for i in ids) * kind.itemsize
        of_record = [r for r in raw if r[1] and dims[r[1][0]][1] == 0]
        one = [size(r[1][1:], r[2]) for r in of_record]
        stride = one[0] if len(one) == 1 else sum(n + -n % 4 for n in one)
        if records == -1 and stride:
            file.seek(0, 2)
            records = (file.tell() - min(r[3] for r in of_record)) // stride
    out = {}
    for name, ids, kind, begin in raw:
        record = bool(ids) and dims[ids[0]][1] == 0
        shape = [records if record and k == 0 else dims[i][1] for k, i in enumerate(ids)]
        slab = math.prod(shape[1:]) * kind.itemsize
        out[name] = Variable(name, [dims[i][0] for i in ids], shape, kind, begin, record, slab, stride if record else slab)
    return out


def local(path: str) -> str:
    """A path that every executor opens: a mounted folder, with or without ``file://``."""
    return path.removeprefix("file://")


@dataclass
class Slab(InputPartition):
    first: int
    end: int


class ClassicNetcdf(DataSource):
    """Options: ``path``, ``variables`` (names with commas), ``slab_bytes`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_classic"

    def _chosen(self) -> list[Variable]:
        known = variables_of(self.options["path"])
        names = [n.strip() for n in self.options.get("variables", "").split(",") if n.strip()]
        if not names:
            raise ValueError("option variables: at least one name is needed")
        for n in names:
            if n not in known:
                raise KeyError(n)
        chosen = [known[n] for n in names]
        if any(v.dims != chosen[0].dims for v in chosen):
            raise ValueError(f"variables {', '.join(names)} differ in their dimensions")
        return chosen

    def schema(self) -> str:
        chosen = self._chosen()
        kind = lambda v: "string" if v.kind.kind == "S" else "double" if v.kind.kind == "f" else "bigint"
        return ", ".join([f"`{d}` bigint" for d in chosen[0].dims] + [f"`{v.name}` {kind(v)}" for v in chosen])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._chosen(), int(self.options.get("slab_bytes", SLAB_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, chosen: list[Variable], slab_bytes: int):
        self.path, self.chosen, self.slab_bytes = path, chosen, slab_bytes

    def partitions(self):
        v = self.chosen[0]
        n = v.shape[0] if v.shape else 1
        step = max(1, self.slab_bytes // max(1, sum(c.slab for c in self.chosen)))
        return [Slab(a, min(n, a + step)) for a in range(0, n, step)] or [Slab(0, 0)]

    def read(self, partition: Slab):
        n, first = partition.end - partition.first, self.chosen[0]
        with open(local(self.path), "rb") as file:
            columns = []
            for v in self.chosen:
                if v.record and v.stride != v.slab:
                    parts = []
                    for i in range(partition.first, partition.end):
                        file.seek(v.begin + i * v.stride)
                        parts.append(file.read(v.slab))
                    raw = b"".join(parts)
                else:
                    file.seek(v.begin + partition.first * v.stride)
                    raw = file.read(n * v.slab)
                x = np.frombuffer(raw, v.kind)
                columns.append(pa.array(x.astype(str)) if v.kind.kind == "S" else pa.array(x.astype(np.float64 if v.kind.kind == "f" else np.int64)))
        shape = [n, *first.shape[1:]] if first.shape else []
        index = [pa.array((i + (partition.first if k == 0 else 0)).ravel()) for k, i in enumerate(np.indices(shape, np.int64))]
        yield pa.RecordBatch.from_arrays(index + columns, [*first.dims, *[v.name for v in self.chosen]])


def read_variables(spark: SparkSession, path: str, *names: str, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    spark.dataSource.register(ClassicNetcdf)
    return spark.read.format("netcdf_classic").option("variables", ",".join(names)).option("slab_bytes", str(slab_bytes)).load(path)


def _corners(spark, path: str, name: str, slab_bytes: int) -> DataFrame:
    """(elem_id, name): connectivity stored as (corner, element), gathered by element."""
    t = read_variables(spark, path, name, slab_bytes=slab_bytes)
    corner, element = t.columns[:2]
    by = t.groupBy(F.col(element).alias("elem_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(corner).alias("k"), F.col(name).alias("n")))).alias("l"))
    return by.select("elem_id", F.col("l.n").alias(name))


def triangular_file(spark: SparkSession, path: str, slab_bytes: int = SLAB_BYTES) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of a file with lon, lat in degrees and 1-based connectivity under one of the known names."""
    from .models import CONNECTIVITY, triangle_mesh

    known = variables_of(path)
    name = next((c for c in CONNECTIVITY if c in known), None)
    if name is None:
        raise RuntimeError(f"no connectivity: one of {', '.join(CONNECTIVITY)} is needed")
    nodes = read_variables(spark, path, "lon", "lat", slab_bytes=slab_bytes)
    return triangle_mesh(nodes.withColumnRenamed(nodes.columns[0], "node_id"), _corners(spark, path, name, slab_bytes))


def radian_mesh_file(spark: SparkSession, path: str, mask: bool = False, parity: bool = False, slab_bytes: int = SLAB_BYTES) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of a file with vlon, vlat in radians, vertex_of_cell and, for ``mask``, cell_sea_land_mask."""
    from .models import icon_mesh

    nodes = read_variables(spark, path, "vlon", "vlat", slab_bytes=slab_bytes)
    cells = _corners(spark, path, "vertex_of_cell", slab_bytes)
    if mask:
        sea = read_variables(spark, path, "cell_sea_land_mask", slab_bytes=slab_bytes)
        cells = cells.join(sea.withColumnRenamed(sea.columns[0], "elem_id"), "elem_id")
    return icon_mesh(nodes.withColumnRenamed(nodes.columns[0], "node_id"), cells, mask, parity)


def mesh_mask_file(spark: SparkSession, path: str, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """(x, y[, z], glamt, gphit, metrics, tmask) of a mesh-mask file; variables without levels hold for each, times beyond the first are left out."""
    known = variables_of(path)
    names = [n for n in ("glamt", "gphit", "e1t", "e2t", "e1u", "e2u", "e1v", "e2v", "e3u_0", "e3v_0", "e3t_0", "tmask") if n in known]
    groups: dict[tuple, list[str]] = {}
    for n in names:
        groups.setdefault(tuple(known[n].dims), []).append(n)
    out = None
    for dims in sorted(groups, key=len, reverse=True):
        t = read_variables(spark, path, *groups[dims], slab_bytes=slab_bytes)
        for d in dims:
            if d not in ("x", "y", "z"):
                t = t.filter(F.col(d) == 0).drop(d)
        out = t if out is None else out.join(t, [d for d in ("z", "y", "x") if d in dims])
    # written once: what prepares a mesh goes through the table several times
    return cut(out.withColumns({d: F.col(d).cast("int") for d in ("x", "y", "z") if d in out.columns}), "mesh-mask")
