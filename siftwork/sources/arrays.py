"""Summaries of array, model and object files from their bytes: NPY, NPZ, Matrix Market, SafeTensors, GGUF, pickle, ONNX,
TFLite, Arrow, Parquet, ORC, Avro, NetCDF classic and MATLAB 5 headers. What has no public layout, or needs a library that
isn't there (HDF5, NetCDF-4, MATLAB 7.3, .tet), is told by its signature and size only."""

from __future__ import annotations

import io
import json
import math
import pickletools
import struct
import zipfile
import zlib
from collections import Counter

from siftwork.config import Config
from siftwork.sources.columns import arrow_stats, cell_text, numeric_stats, sample_size, table_stats

# How much of a file is reported. Totals are told beside what is cut.
MOST_TENSORS, MOST_KEYS, MOST_LABELS, MOST_OPCODES, MOST_GLOBALS, MOST_ARRAYS, MOST_SUBGRAPHS, MOST_ATTRIBUTES = 128, 64, 48, 500_000, 256, 128, 32, 256
#: Values of a tensor, and of one plane, that are looked at; cells of a matrix up to which its columns are.
MOST_VALUES, MOST_PLANE, MOST_CELLS = 2_000_000, 200_000, 8_000_000


def dims(shape: list[int]) -> tuple[int | None, int | None]:
    """Rows and columns of a shape: a scalar is 1 by 1, a vector n by 1, higher ranks none."""
    return {0: (1, 1), 1: (*shape, 1), 2: tuple(shape)}.get(len(shape), (None, None))  # type: ignore[return-value]


def npy_header(data: bytes) -> dict:
    import ast

    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    major, minor = data[6], data[7]
    size, at = (struct.unpack("<H", data[8:10])[0], 10) if major == 1 else (struct.unpack("<I", data[8:12])[0], 12)
    head = ast.literal_eval(data[at : at + size].decode("latin1"))
    shape = list(head["shape"])
    rows, columns = dims(shape)
    return {"format_version": f"{major}.{minor}", "dtype": head["descr"], "shape": shape, "fortran_order": head["fortran_order"], "data_offset": at + size, "row_count": rows, "column_count": columns}


def _decoded(a) -> list[list[str]]:
    """Rows of an array of rank 2 at most as texts: whole numbers as they are, others with 15 digits, NaN as an empty cell."""
    show = (lambda v: "" if v != v else f"{v:.15f}") if a.dtype.kind == "f" else (lambda v: "true" if v else "false") if a.dtype.kind == "b" else str
    return [[show(v) for v in row] for row in a.reshape(len(a) if a.ndim else 1, -1).tolist()]


def stack_axis(shape: list[int], fortran: bool = False) -> int:
    """The axis with the fewest planes, the first one on a tie; of a cube the one that memory is contiguous along."""
    return (2 if fortran else 0) if len(set(shape)) == 1 else shape.index(min(shape))


def spaced(n: int, most: int) -> list[int]:
    """Up to ``most`` indices from 0 to n - 1, evenly spread."""
    return list(range(n)) if n <= most else [k * (n - 1) // max(1, most - 1) for k in range(most)]


def _figures(x) -> dict:
    import numpy as np

    x = x.astype("float64")
    fine = x[np.isfinite(x)]
    out = {"n_pos": int(fine.size), "min": float(fine.min()) if fine.size else 0.0, "max": float(fine.max()) if fine.size else 0.0, "mean": float(fine.mean()) if fine.size else 0.0}
    return out | ({"stdev": float(fine.std())} if fine.size > 1 else {})


def tensor_stats(a, fortran: bool = False) -> dict:
    """Figures of an array of rank 3 and of its planes along the axis with the fewest of them: at most as many planes as
    `reported_planes` says, with a stride where a plane or the whole holds more values than are looked at."""
    import numpy as np

    axis = stack_axis(list(a.shape), fortran)
    n = a.shape[axis]
    most = min(64, 32 + 3 * max(0, len(str(max(1, n))) - 4)) if n else 0
    flat = a.reshape(-1)[:: max(1, -(-a.size // MOST_VALUES))]
    planes = []
    for k in spaced(n, most):
        x = np.take(a, k, axis=axis).reshape(-1)
        planes.append({"plane": k} | _figures(x[:: max(1, -(-x.size // MOST_PLANE))]))
    f = flat.astype("float64")
    whole = _figures(flat) | {"n_nan": int(np.isnan(f).sum()), "n_inf": int(np.isinf(f).sum())}
    return {"along_axis": axis, "elements_sampled": sum(p["n_pos"] for p in planes), "global": whole, "planes": planes}


def bytes_needed(head: dict, file_bytes: int, config: Config) -> int:
    """Bytes from the start of an array file that its statistics need: all for rank 3, else those of the rows looked at."""
    import numpy as np

    size, shape = np.dtype(head["dtype"]).itemsize, head["shape"]
    if len(shape) > 2:
        return head["data_offset"] + size * int(np.prod(shape)) if len(shape) == 3 else head["data_offset"]
    rows, columns = head["row_count"], head["column_count"]
    some = min(rows, sample_size(file_bytes, rows, max(1, columns), config.max_tabular_sample_rows))
    items = some * columns if len(shape) < 2 or not head["fortran_order"] else (columns - 1) * rows + some
    return head["data_offset"] + size * items if some else head["data_offset"]


def npy_stats(data: bytes, file_bytes: int, config: Config) -> dict:
    """Column statistics of an array of rank 2 at most, or plane statistics of one of rank 3, from the first bytes of a file.
    Arrays of objects, texts and complex numbers are told by their shape only."""
    import numpy as np

    head = npy_header(data)
    shape, kind = head["shape"], head["dtype"]
    if not isinstance(kind, str) or np.dtype(kind).kind not in "iufb" or len(shape) > 3 or 0 in shape:
        return {}
    dtype, order = np.dtype(kind), "F" if head["fortran_order"] else "C"
    held = np.frombuffer(data, dtype=dtype, offset=head["data_offset"], count=(len(data) - head["data_offset"]) // dtype.itemsize)
    if len(shape) == 3:
        return {"tensor3d": tensor_stats(held[: int(np.prod(shape))].reshape(shape, order=order), head["fortran_order"])} if held.size >= np.prod(shape) else {}
    rows, columns = head["row_count"], head["column_count"]
    some = min(rows, sample_size(file_bytes, rows, max(1, columns), config.max_tabular_sample_rows))
    if len(shape) == 2 and order == "F":
        at = np.arange(columns)[None, :] * rows + np.arange(some)[:, None]
        if not held.size or at.max() >= held.size:
            return {}
        part = held[at]
    else:
        some = min(some, held.size // max(1, columns))
        part = held[: some * columns].reshape(some, columns)
    return {"encoding": "numpy", "stats_rows_sampled": some, "columns": table_stats(_decoded(part), [f"col{k}" for k in range(columns)])} if some else {}


def npy_summary(data: bytes, path: str = "", config: Config = Config()) -> dict:
    return npy_header(data) | npy_stats(data, len(data), config)


def npy_rows(data: bytes, config: Config = Config()) -> list[list[str]]:
    """The sampled rows of an array file as texts, for profiles of their own."""
    import numpy as np

    head = npy_header(data)
    if len(head["shape"]) > 2:
        raise ValueError("an array of more than two dimensions has no rows")
    a = np.load(io.BytesIO(data), allow_pickle=False)
    n = sample_size(len(data), head["row_count"], max(1, head["column_count"]), config.max_tabular_sample_rows)
    return _decoded(np.atleast_1d(a)[:n])


def npz_summary(data: bytes, path: str = "", config: Config = Config()) -> dict:
    """Members with their statistics; of each only the bytes that they need are unpacked."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.endswith(".npy")]
        entries = []
        for n in names[:MOST_ARRAYS]:
            size = z.getinfo(n).file_size
            with z.open(n) as f:
                first = f.read(65_536)
                head = npy_header(first)
                need = min(bytes_needed(head, size, config) if isinstance(head["dtype"], str) else 0, config.max_zip_entry_uncompressed_bytes or size)
                first += f.read(max(0, need - len(first)))
                entries.append({"name": n} | head | npy_stats(first, size, config))
        return {"zip_entry_count": len(z.namelist()), "npy_entries_scanned": len(entries), "npy_entries_total": len(names), "npy_entries": entries}


def sparse_stats(columns: dict[int, list[float]], rows: int, n: int) -> list[dict]:
    """Moments of each column of a matrix whose other cells are 0: population deviation, neither median nor iqr."""
    out = []
    for c in range(n):
        v = [x for x in columns.get(c, ()) if math.isfinite(x)]
        mean = math.fsum(v) / rows if rows else 0.0
        lo, hi = (min(v), max(v)) if v else (0.0, 0.0)
        lo, hi = (min(lo, 0.0), max(hi, 0.0)) if len(v) < rows else (lo, hi)
        dev = math.sqrt(max(0.0, math.fsum(x * x for x in v) / rows - mean * mean)) if rows else 0.0
        out.append({"name": f"col{c}", "type": "number", "numeric_stats": {"min": lo, "max": hi, "mean": mean, "range": hi - lo, "stdev": dev}})
    return out


def mtx_summary(data: bytes, path: str = "", config: Config = Config()) -> dict:
    """Layout of a matrix, and the statistics of its columns where it has at most MOST_CELLS cells. Cells that a sparse matrix
    doesn't store are 0; of a symmetric one, each stored cell counts on both sides of the diagonal."""
    head, *rest = data.decode().splitlines()
    parts = head.lower().split()
    if len(parts) < 5 or parts[0] != "%%matrixmarket":
        raise ValueError("not a Matrix Market file")
    body = (x for x in rest if x.strip() and not x.startswith("%"))
    size = [int(x) for x in next(body).split()]
    rows, n, sparse = size[0], size[1], parts[2] == "coordinate"
    out = {"storage": "sparse" if sparse else "dense", "value_type": parts[3], "symmetry": parts[4], "row_count": rows, "column_count": n, "num_stored_values": size[2] if sparse else rows * n, "encoding": "matrix-market"}
    if rows * n > MOST_CELLS or parts[3] == "complex":
        return out | {"note": "statistics of real matrices of at most 8,000,000 cells only"}
    columns: dict[int, list[float]] = {}
    twice = parts[4] in ("symmetric", "skew-symmetric")
    sign = -1.0 if parts[4] == "skew-symmetric" else 1.0
    if sparse:
        for line in body:
            f = line.split()
            r, c, x = int(f[0]) - 1, int(f[1]) - 1, float(f[2]) if len(f) > 2 else 1.0
            columns.setdefault(c, []).append(x)
            if twice and r != c:
                columns.setdefault(r, []).append(sign * x)
        return out | {"columns": sparse_stats(columns, rows, n)}
    values = [float(x) for line in body for x in line.split()]
    if twice:  # the lower triangle, column by column
        at = iter(values)
        for c in range(n):
            for r in range(c if sign > 0 else c + 1, rows):
                x = next(at)
                columns.setdefault(c, []).append(x)
                if r != c:
                    columns.setdefault(r, []).append(sign * x)
    else:
        for c in range(n):
            columns[c] = values[c * rows : (c + 1) * rows]
    return out | {"columns": [{"name": f"col{c}", "type": "number", "numeric_stats": numeric_stats(columns.get(c, []))} for c in range(n)]}


def safetensors_summary(data: bytes) -> dict:
    n = struct.unpack("<Q", data[:8])[0]
    head = json.loads(data[8 : 8 + n])
    head.pop("__metadata__", None)
    names = sorted(head)
    return {
        "tensor_count": len(names),
        "dtype_counts": dict(sorted(Counter(v["dtype"] for v in head.values()).items(), key=lambda x: (-x[1], x[0]))[:32]),
        "tensors": [{"name": k, "dtype": head[k]["dtype"], "shape": head[k]["shape"]} for k in names[:MOST_TENSORS]],
    }


def gguf_summary(data: bytes) -> dict:
    if data[:4] != b"GGUF":
        raise ValueError("not a GGUF file")
    at = 4
    scalars = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}

    def take(fmt):
        nonlocal at
        v = struct.unpack_from(fmt, data, at)[0]
        at += struct.calcsize(fmt)
        return v

    def text():
        nonlocal at
        n = take("<Q")
        at += n
        return data[at - n : at].decode("utf-8", "replace")

    def value(kind):
        if kind == 8:
            return text()
        if kind == 9:
            inner, n = take("<I"), take("<Q")
            got = [value(inner) for _ in range(n)]
            return {"type": "array", "length": n, "first": got[:3]}
        return take(scalars[kind])

    version, tensors, pairs = take("<I"), take("<Q"), take("<Q")
    kv = {text(): value(take("<I")) for _ in range(pairs)}
    found = []
    for _ in range(tensors):
        name, rank = text(), take("<I")
        shape = [take("<Q") for _ in range(rank)]
        found.append({"name": name, "shape": shape, "type": take("<I"), "offset": take("<Q")})
    return {"version": version, "num_kv": pairs, "num_tensor": tensors, "kv": dict(list(kv.items())[:MOST_KEYS]), "tensor_summaries": found[:MOST_TENSORS]}


def pickle_summary(data: bytes) -> dict:
    """Protocol, opcodes and referenced globals; nothing is ever unpickled. Names kept in the memo are found again."""
    opcodes, frames, protocol, names = 0, 0, 0, []
    recent: list[str | None] = []  # what was pushed last, texts only
    memo: dict[int, str | None] = {}
    for op, arg, _ in pickletools.genops(data):
        opcodes += 1
        if op.name == "PROTO":
            protocol = arg
        elif op.name == "FRAME":
            frames += 1
        elif op.name in ("GLOBAL", "INST"):
            names.append(arg.replace(" ", "."))
            recent.append(None)
        elif op.name == "STACK_GLOBAL":
            if len(recent) > 1 and recent[-2] is not None and recent[-1] is not None:
                names.append(f"{recent[-2]}.{recent[-1]}")
            recent[-2:] = [None]
        elif op.name == "MEMOIZE":
            memo[len(memo)] = recent[-1] if recent else None
        elif op.name in ("PUT", "BINPUT", "LONG_BINPUT"):
            memo[int(arg)] = recent[-1] if recent else None
        elif op.name in ("GET", "BINGET", "LONG_BINGET"):
            recent.append(memo.get(int(arg)))
        elif op.stack_after:
            recent.append(arg if isinstance(arg, str) else None)
        del recent[:-8]
        if opcodes >= MOST_OPCODES:
            break
    seen = list(dict.fromkeys(names))
    of = lambda own: [n for n in seen if n.startswith(("builtins.", "__builtin__.")) == own][:MOST_GLOBALS]
    return {"protocol": protocol, "encoding": "binary" if protocol else "text", "opcode_count": opcodes, "truncated": opcodes >= MOST_OPCODES or None, "frame_count": frames, "builtin_types": of(True), "referenced_globals": of(False)}


def _fields(data: bytes):
    """Field number, wire type and value of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            v = varint()
        elif kind == 2:
            n = varint()
            v = data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v = data[at : at + n]
            at += n
        else:
            raise ValueError("not a protobuf message")
        yield key >> 3, v


def onnx_summary(data: bytes) -> dict:
    out: dict = {"ir_version": None, "producer": None, "opset_import": []}
    nodes: Counter = Counter()
    counts = {"initializer_count": 0, "input_count": 0, "output_count": 0}
    for no, v in _fields(data):
        if no == 1:
            out["ir_version"] = v
        elif no == 2:
            out["producer"] = v.decode("utf-8", "replace")
        elif no == 8:
            out["opset_import"].append(dict((("domain", x.decode()) if k == 1 else ("version", x)) for k, x in _fields(v) if k in (1, 2)))
        elif no == 7:
            for k, x in _fields(v):
                if k == 1:
                    nodes[next((y.decode() for j, y in _fields(x) if j == 4), "")] += 1
                elif k in (5, 11, 12):
                    counts[{5: "initializer_count", 11: "input_count", 12: "output_count"}[k]] += 1
    top = sorted(nodes.items(), key=lambda x: (-x[1], x[0]))[:MOST_LABELS]
    return out | counts | {"node_count": sum(nodes.values()), "op_type_counts": dict(top)}


class _Flat:
    """A table of a flatbuffer."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.fields = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.fields)[0]

    def place(self, k: int) -> int | None:
        off = struct.unpack_from("<H", self.data, self.fields + 4 + 2 * k)[0] if 4 + 2 * k < self.size else 0
        return self.at + off if off else None

    def number(self, k: int, fmt: str = "<i", other: int = 0) -> int:
        p = self.place(k)
        return other if p is None else struct.unpack_from(fmt, self.data, p)[0]

    def _follow(self, p: int) -> int:
        return p + struct.unpack_from("<I", self.data, p)[0]

    def text(self, k: int) -> str | None:
        p = self.place(k)
        if p is None:
            return None
        q = self._follow(p)
        return self.data[q + 4 : q + 4 + struct.unpack_from("<I", self.data, q)[0]].decode("utf-8", "replace")

    def tables(self, k: int) -> list[_Flat]:
        p = self.place(k)
        if p is None:
            return []
        q = self._follow(p)
        return [_Flat(self.data, self._follow(q + 4 + 4 * j)) for j in range(struct.unpack_from("<I", self.data, q)[0])]

    def count(self, k: int) -> int:
        p = self.place(k)
        return 0 if p is None else struct.unpack_from("<I", self.data, self._follow(p))[0]


def tflite_summary(data: bytes) -> dict:
    """Schema version, subgraphs, and a histogram of the operators by their code, custom ones by name."""
    if data[4:8] != b"TFL3":
        raise ValueError("not a TFLite file")
    model = _Flat(data, struct.unpack_from("<I", data, 0)[0])
    codes = [c.text(1) or f"op_{max(c.number(0, '<b'), c.number(3))}" for c in model.tables(1)]
    graphs = model.tables(2)
    used: Counter = Counter()
    for g in graphs:
        for o in g.tables(3):
            k = o.number(0, "<I")
            used[codes[k] if k < len(codes) else "unknown"] += 1
    top = sorted(used.items(), key=lambda x: (-x[1], x[0]))[:MOST_LABELS]
    told = [{"name": g.text(4), "tensor_count": g.count(0), "input_count": g.count(1), "output_count": g.count(2), "operator_count": g.count(3)} for g in graphs[:MOST_SUBGRAPHS]]
    return {"schema_version": model.number(0, "<I"), "description": model.text(3), "operator_code_count": len(codes), "subgraph_count": len(graphs), "subgraphs": told, "operator_count": sum(used.values()), "op_type_counts": dict(top)}


def arrow_summary(data: bytes, path: str = "", config: Config = Config()) -> dict:
    import pyarrow as pa

    stream = data[:6] != b"ARROW1"
    kind = "ipc_stream" if stream else "feather" if path.lower().endswith(".feather") else "ipc_file"
    open_ = lambda: pa.ipc.open_stream(io.BytesIO(data)) if stream else pa.ipc.open_file(io.BytesIO(data))
    batches = lambda r: iter(r) if stream else (r.get_batch(i) for i in range(r.num_record_batches))
    rows = sum(b.num_rows for b in batches(open_()))
    again = open_()
    return {"container_kind": kind, "row_count": rows, "encoding": "binary"} | arrow_stats(again.schema, batches(again), len(data), rows, config)


def parquet_summary(data: bytes, path: str = "", config: Config = Config()) -> dict:
    import pyarrow.parquet as pq

    f = pq.ParquetFile(io.BytesIO(data))
    rows = f.metadata.num_rows
    return {"row_count": rows, "num_row_groups": f.metadata.num_row_groups, "encoding": "binary"} | arrow_stats(f.schema_arrow, f.iter_batches(4096), len(data), rows, config)


def orc_summary(data: bytes, path: str = "", config: Config = Config()) -> dict:
    import pyarrow.orc as orc

    f = orc.ORCFile(io.BytesIO(data))
    stripes = (f.read_stripe(k) for k in range(f.nstripes))
    return {"row_count": f.nrows, "num_stripes": f.nstripes, "encoding": "binary"} | arrow_stats(f.schema, stripes, len(data), f.nrows, config)


class _Avro:
    """Values of an Avro container from its bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.named = data, 0, {}

    def long(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (out >> 1) ^ -(out & 1)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def bytes_(self) -> bytes:
        return self.take(self.long())

    def blocks(self):
        while (n := self.long()) != 0:
            if n < 0:
                self.long()
            yield from range(abs(n))

    def learn(self, schema) -> None:
        """Named types, so that later mentions are found."""
        if isinstance(schema, list):
            for s in schema:
                self.learn(s)
        elif isinstance(schema, dict):
            if schema.get("name"):
                self.named[schema["name"]] = schema
                self.named[f"{schema.get('namespace', '')}.{schema['name']}"] = schema
            for s in (schema.get("items"), schema.get("values"), *[f["type"] for f in schema.get("fields", ())]):
                self.learn(s)
            if isinstance(schema.get("type"), dict | list):
                self.learn(schema["type"])

    def value(self, schema):
        if isinstance(schema, list):
            return self.value(schema[self.long()])
        kind = schema["type"] if isinstance(schema, dict) else schema
        if isinstance(kind, dict | list):
            return self.value(kind)
        if kind == "null":
            return None
        if kind == "boolean":
            return self.take(1) == b"\x01"
        if kind in ("int", "long"):
            return self.long()
        if kind in ("float", "double"):
            return struct.unpack("<f" if kind == "float" else "<d", self.take(4 if kind == "float" else 8))[0]
        if kind == "bytes":
            return self.bytes_()
        if kind == "string":
            return self.bytes_().decode("utf-8", "replace")
        if kind == "fixed":
            return self.take(schema["size"])
        if kind == "enum":
            return schema["symbols"][self.long()]
        if kind == "array":
            return [self.value(schema["items"]) for _ in self.blocks()]
        if kind == "map":
            return {self.bytes_().decode("utf-8", "replace"): self.value(schema["values"]) for _ in self.blocks()}
        if kind in ("record", "error"):
            return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
        return self.value(self.named[kind])


def avro_summary(data: bytes, path: str = "", config: Config = Config()) -> dict:
    """Schema, codec, rows and column statistics of an object container file. Rows of other codecs than null and deflate are
    counted only."""
    if data[:4] != b"Obj\x01":
        raise ValueError("not an Avro container file")
    a = _Avro(data)
    a.at = 4
    meta = {}
    for _ in a.blocks():
        k = a.bytes_().decode()
        meta[k] = a.bytes_()
    a.at += 16
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    fields = schema.get("fields", []) if isinstance(schema, dict) else []
    names = [f["name"] for f in fields] or ["value"]
    most = sample_size(len(data), None, len(names), config.max_tabular_sample_rows)
    rows, some = 0, []
    while a.at < len(data):
        n = a.long()
        block = a.bytes_()
        a.at += 16
        rows += n
        if len(some) < most and codec in ("null", "deflate"):
            inner = _Avro(zlib.decompress(block, -15) if codec == "deflate" else block)
            inner.learn(schema)
            for _ in range(min(n, most - len(some))):
                v = inner.value(schema)
                some.append([cell_text(v[x]) for x in names] if fields else [cell_text(v)])
    physical = [f["type"] if isinstance(f["type"], str) else json.dumps(f["type"]) for f in fields] or [json.dumps(schema)]
    stats = table_stats(some, names, None, physical) if some else [{"name": n, "physical_type": t} for n, t in zip(names, physical)]
    canonical = json.dumps(schema, separators=(",", ":"))
    return {"row_count": rows, "codec": codec, "schema_canonical": canonical, "encoding": "binary", "column_count": len(names), "stats_rows_sampled": len(some), "columns": stats}


def attribute_text(v) -> str:
    """An attribute as text: one value alone, several with commas."""
    return v if isinstance(v, str) else ", ".join(map(str, v)) if isinstance(v, list | tuple) else str(v)


def netcdf_summary(data: bytes) -> dict:
    """Attributes, dimensions and variables of a classic file; NetCDF-4 files are told by their HDF5 signature."""
    if data[:8] == b"\x89HDF\r\n\x1a\n":
        return {"format": "netcdf4", "stream_size": len(data), "note": "needs an HDF5 library"}
    if data[:3] != b"CDF":
        raise ValueError("not a NetCDF file")
    wide = data[3] == 5  # counts of 64 bits
    at = 4
    kinds = {1: ("b", 1), 2: ("s", 1), 3: ("h", 2), 4: ("i", 4), 5: ("f", 4), 6: ("d", 8), 7: ("B", 1), 8: ("H", 2), 9: ("I", 4), 10: ("q", 8), 11: ("Q", 8)}
    labels = {1: "byte", 2: "char", 3: "short", 4: "int", 5: "float", 6: "double", 7: "ubyte", 8: "ushort", 9: "uint", 10: "int64", 11: "uint64"}

    def take(fmt):
        nonlocal at
        v = struct.unpack_from(">" + fmt, data, at)[0]
        at += struct.calcsize(fmt)
        return v

    count = lambda: take("Q" if wide else "I")

    def name():
        nonlocal at
        n = count()
        v = data[at : at + n].decode("utf-8", "replace")
        at += (n + 3) // 4 * 4
        return v

    def attributes():
        nonlocal at
        take("I")
        out = {}
        for _ in range(count()):
            key, kind, n = name(), take("I"), count()
            letter, size = kinds[kind]
            v = data[at : at + n].rstrip(b"\0").decode("utf-8", "replace") if letter == "s" else list(struct.unpack_from(f">{n}{letter}", data, at))
            at += (n * size + 3) // 4 * 4
            out[key] = attribute_text(v)
        return out

    records = count()
    take("I")
    dims_ = [{"name": name(), "size": count()} for _ in range(count())]
    shared = attributes()
    take("I")
    variables = []
    for _ in range(count()):
        label, n = name(), count()
        own = [count() for _ in range(n)]
        extra, kind = attributes(), take("I")
        count()
        take("Q" if data[3] != 1 else "I")
        variables.append({"name": label, "type": labels.get(kind, "unknown"), "dimensions": [dims_[k]["name"] for k in own], "shape": [dims_[k]["size"] or records for k in own], "attributes": dict(list(extra.items())[:MOST_ATTRIBUTES])})
    return {
        "format": f"classic {data[3]}", "record_count": records, "dimension_count": len(dims_), "dimensions_sample": dims_[:MOST_ATTRIBUTES], "global_attributes": dict(list(shared.items())[:512]),
        "variable_count": len(variables), "variables": variables[:10_000],
    }


_MAT_CLASSES = {1: "cell", 2: "struct", 3: "object", 4: "char", 5: "sparse", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}
_MAT_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


class _Mat:
    """Elements of a MATLAB 5 file."""

    def __init__(self, data: bytes, end: str):
        self.data, self.end, self.at = data, end, 0

    def element(self) -> tuple[int, bytes]:
        """Kind and body of the next element."""
        kind, n = struct.unpack_from(self.end + "II", self.data, self.at)
        if kind >> 16:
            body = self.data[self.at + 4 : self.at + 4 + (kind >> 16)]
            self.at += 8
            return kind & 0xFFFF, body
        body = self.data[self.at + 8 : self.at + 8 + n]
        self.at += 8 + (n if kind == 15 else (n + 7) // 8 * 8)
        return kind, body


def _mat_array(body: bytes, end: str, depth: int, walked: list[dict], key: str) -> dict:
    """Name, class, shape and figures of one array; of structs and cells the kinds below them, by place."""
    import numpy as np

    m = _Mat(body, end)
    flags = struct.unpack_from(end + "I", m.element()[1])[0]
    cls, is_complex, logical = flags & 255, bool(flags & 0x800), bool(flags & 0x200)
    raw = m.element()[1]
    shape = list(struct.unpack(end + f"{len(raw) // 4}i", raw))
    name = m.element()[1].decode("latin1")
    label = "logical" if logical else _MAT_CLASSES.get(cls, "unknown")
    out: dict = {"name": name, "class": label, "shape": shape}
    if is_complex:
        out["is_complex"] = True
    if depth > 0 and len(walked) < 4096:
        walked.append({"depth": depth, "key": key or name, "class": label})
    if cls in (2, 3):
        if cls == 3:
            out["object_class"] = m.element()[1].decode("latin1")
        width = struct.unpack(end + "i", m.element()[1])[0]
        packed = m.element()[1]
        names = [packed[k : k + width].rstrip(b"\0").decode("latin1") for k in range(0, len(packed), width)] if width else []
        out["field_count"], out["fields"] = len(names), names[:256]
        if depth < 32:
            for k in range(min(int(np.prod(shape)), 4096) * len(names)):
                _mat_array(m.element()[1], end, depth + 1, walked, names[k % len(names)])
    elif cls == 1:
        for k in range(min(int(np.prod(shape)), 64) if depth < 32 else 0):
            _mat_array(m.element()[1], end, depth + 1, walked, f"{{{k}}}")
    elif m.at < len(body) and (cls == 4 or cls >= 6):
        kind, part = m.element()
        if cls == 4:
            text = part.decode({2: "latin1", 4: "utf-16-le" if end == "<" else "utf-16-be", 16: "utf-8", 17: "utf-16-le" if end == "<" else "utf-16-be"}.get(kind, "latin1"), "replace")
            out["unique_chars"] = min(len(set(text[:MOST_PLANE])), 256)
            if len(text) <= 256:
                out["text"] = text
        elif kind in _MAT_NUMBERS:
            v = np.frombuffer(part, dtype=end + _MAT_NUMBERS[kind])
            some = v[:: max(1, -(-v.size // MOST_VALUES))].astype("float64")
            if v.size == 1:
                out["value"] = bool(v[0]) if logical else v[0].item()
            if v.size:
                out["stats"] = _figures(some)
                out["nan_count"], out["inf_count"] = int(np.isnan(some).sum()), int(np.isinf(some).sum())
            if len(shape) == 3 and v.size == np.prod(shape):
                out["tensor3d"] = tensor_stats(v.reshape(shape, order="F"), True)
    return out


def mat_summary(data: bytes) -> dict:
    """Names, classes, shapes and figures of the variables of a MATLAB 5 file."""
    if data[:8] == b"\x89HDF\r\n\x1a\n" or b"MATLAB 7.3" in data[:128]:
        return {"mat_format": "7.3", "stream_size": len(data), "error": "needs an HDF5 library"}
    end = "<" if data[126:128] == b"IM" else ">"
    m, found, seen = _Mat(data, end), [], 0
    m.at = 128
    while m.at + 8 <= len(data):
        kind, body = m.element()
        if kind == 15:
            inner = _Mat(zlib.decompress(body), end)
            kind, body = inner.element()
        if kind != 14:
            continue
        seen += 1
        if len(found) < MOST_ARRAYS:
            walked: list[dict] = []
            told = _mat_array(body, end, 0, walked, "")
            if walked:
                told["members"] = walked[:4096]
            found.append(told)
    return {"mat_format": "5", "variable_count": seen, "entries": found}


def hdf5_summary(data: bytes) -> dict:
    if data[:8] != b"\x89HDF\r\n\x1a\n":
        raise ValueError("not an HDF5 file")
    return {"superblock_version": data[8], "stream_size": len(data), "note": "datasets need an HDF5 library"}
