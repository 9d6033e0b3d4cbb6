"""The classic NetCDF source on files that the tests write themselves."""

import struct

import numpy as np
import pytest

from meshspark.sources import netcdf

CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


def write(path, dims, variables, version=1):
    """``dims``: name to length, None for records; ``variables``: name to (dimensions, array)."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    num = lambda n: struct.pack(">i", n)
    name = lambda s: num(len(s)) + pad(s.encode())
    names = list(dims)
    code = lambda a: CODES[a.dtype.str[1:]]
    arrays = {v: (d, np.asarray(a).astype(np.asarray(a).dtype.newbyteorder(">"))) for v, (d, a) in variables.items()}
    record = {v: dims[d[0]] is None if d else False for v, (d, _) in arrays.items()}
    n_records = max([len(a) for v, (_, a) in arrays.items() if record[v]], default=0)

    def header(begins):
        out = b"CDF" + bytes([version]) + num(n_records)
        out += num(10) + num(len(dims)) + b"".join(name(d) + num(n or 0) for d, n in dims.items())
        out += num(12) + num(1) + name("title") + num(2) + num(5) + pad(b"hello")
        out += num(11) + num(len(arrays))
        for v, (d, a) in arrays.items():
            size = a[0].nbytes if record[v] else a.nbytes
            out += name(v) + num(len(d)) + b"".join(num(names.index(x)) for x in d)
            out += num(12) + num(1) + name("units") + num(6) + num(1) + struct.pack(">d", 1.5)
            out += num(code(a)) + num(size + -size % 4) + struct.pack(">q" if version == 2 else ">i", begins[v])
        return out

    at, begins = len(header(dict.fromkeys(arrays, 0))), {}
    body = b""
    for v, (_, a) in arrays.items():
        if not record[v]:
            begins[v] = at + len(body)
            body += pad(a.tobytes())
    start = at + len(body)
    of_record = [v for v in arrays if record[v]]
    for v in of_record:
        begins[v] = start
        start += arrays[v][1][0].nbytes if len(of_record) == 1 else len(pad(arrays[v][1][:1].tobytes()))
    for i in range(n_records):
        for v in of_record:
            raw = arrays[v][1][i : i + 1].tobytes()
            body += raw if len(of_record) == 1 else pad(raw)
    path.write_bytes(header(begins) + body)


@pytest.mark.parametrize("version", [1, 2])
def test_slabs_and_types(spark, tmp_path, version):
    a = np.arange(60, dtype="f4").reshape(5, 4, 3) / 2
    b = np.arange(60, dtype="i2").reshape(5, 4, 3)
    t = np.arange(3, dtype="f8") * 10
    r = np.arange(15, dtype="i1").reshape(3, 5)
    write(tmp_path / "x.nc", {"time": None, "z": 5, "y": 4, "x": 3}, {"a": (["z", "y", "x"], a), "b": (["z", "y", "x"], b), "t": (["time"], t), "r": (["time", "z"], r)}, version)
    path = f"{tmp_path}/x.nc"
    df = netcdf.read_variables(spark, path, "a", "b", slab_bytes=100)
    assert df.rdd.getNumPartitions() == 5 and df.schema.simpleString() == "struct<z:bigint,y:bigint,x:bigint,a:double,b:bigint>"
    got = sorted(map(tuple, df.collect()))
    assert got == [(z, y, x, float(a[z, y, x]), int(b[z, y, x])) for z in range(5) for y in range(4) for x in range(3)]
    assert sorted(map(tuple, netcdf.read_variables(spark, f"file://{path}", "t").collect())) == [(i, 10.0 * i) for i in range(3)]
    assert sorted(map(tuple, netcdf.read_variables(spark, path, "r", slab_bytes=6).collect())) == [(i, z, int(r[i, z])) for i in range(3) for z in range(5)]
    for bad, error in (("nothing", KeyError), ("a,t", ValueError)):
        with pytest.raises(Exception, match="nothing" if error is KeyError else "differ"):
            netcdf.read_variables(spark, path, *bad.split(",")).collect()
    (tmp_path / "no.nc").write_bytes(b"HDF5....")
    with pytest.raises(ValueError, match="not a classic"):
        netcdf.variables_of(f"{tmp_path}/no.nc")


def test_model_files(spark, tmp_path):
    from meshspark.plans import prepare

    lon, lat = np.array([0.0, 1.0, 0.0, 1.0]), np.array([0.0, 0.0, 1.0, 1.0])
    tri = np.array([[1, 2], [2, 4], [3, 3]], "i4")
    write(tmp_path / "t.nc", {"n": 4, "three": 3, "e": 2}, {"lon": (["n"], lon), "lat": (["n"], lat), "elem": (["three", "e"], tri)})
    nodes, elements = netcdf.triangular_file(spark, f"{tmp_path}/t.nc", slab_bytes=8)
    assert [r.nodes for r in elements.orderBy("elem_id").collect()] == [[0, 1, 2], [1, 3, 2]]
    assert prepare.prepare_triangular(nodes, elements, cartesian=False).operator.count() == 14
    write(tmp_path / "bare.nc", {"n": 4}, {"lon": (["n"], lon)})
    with pytest.raises(RuntimeError):
        netcdf.triangular_file(spark, f"{tmp_path}/bare.nc")
    rad = {"vlon": (["vertex"], np.radians(lon)), "vlat": (["vertex"], np.radians(lat)), "vertex_of_cell": (["nv", "cell"], tri), "cell_sea_land_mask": (["cell"], np.array([-2, 1], "i4"))}
    write(tmp_path / "r.nc", {"vertex": 4, "nv": 3, "cell": 2}, rad, 2)
    nodes, elements = netcdf.radian_mesh_file(spark, f"{tmp_path}/r.nc", mask=True)
    assert np.allclose([r.x for r in nodes.orderBy("node_id").collect()], lon)
    assert [r.ocean for r in elements.orderBy("elem_id").collect()] == [True, False]
    ny, nx, nz = 6, 8, 2
    flat = {n: (["t", "y", "x"], np.full((1, ny, nx), 1000.0 + i)) for i, n in enumerate(("e1t", "e2t", "e1u", "e2u", "e1v", "e2v"))}
    x, y = np.meshgrid(np.arange(nx), np.arange(ny))
    flat["glamt"] = (["t", "y", "x"], np.where(y == ny - 2, 3.0 * x, np.where(y == ny - 1, 3.0 * (nx - 1 - x), 3.0 * x + 0.5 + y))[None])
    flat["gphit"] = (["t", "y", "x"], y[None] * 1.0)
    deep = {n: (["t", "z", "y", "x"], np.full((1, nz, ny, nx), 1000.0)) for n in ("e3u_0", "e3v_0", "e3t_0")}
    deep["tmask"] = (["t", "z", "y", "x"], np.ones((1, nz, ny, nx), "i1"))
    write(tmp_path / "m.nc", {"t": None, "z": nz, "y": ny, "x": nx}, flat | deep)
    mesh = netcdf.mesh_mask_file(spark, f"{tmp_path}/m.nc", slab_bytes=64)
    assert mesh.count() == nz * ny * nx
    op = prepare.prepare_mesh_mask(mesh, 1)
    top = {(r.i, r.j) for r in op.operator.collect() if r.i % (ny - 2) == ny - 3 and r.j % (ny - 2) == ny - 3}
    assert (ny - 3, (nx - 3) * (ny - 2) + ny - 3) in top  # the first column meets the last one across the fold
