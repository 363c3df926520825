"""What feature archives hold, as tables of fields; a Spark data source that reads them and a sink that publishes all of a job's archives or none.

``spark.dataSource.register(npz.FeatureArchives)``, then ``spark.read.format("feature_archives").option("kind", "keypoints").load(path)``.  Files
are planned into partitions by size; filters on ``path`` leave files out before anything is read (with ``spark.sql.python.filterPushdown.enabled``);
a schema that names some columns reads only the arrays that these need, so vectors are not even unpacked if ``v`` is not among them.
"""

from __future__ import annotations

import fnmatch
import io
import json
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "feature_archives"


# ---------------------------------------------------------------- fields
@dataclass(frozen=True)
class Field:
    """An array of an archive.  ``shape`` has a number, or a name that must mean the same size wherever it stands, for each dimension;
    ``()`` is a single number, however it is stored."""

    name: str
    shape: tuple = ()
    required: bool = False
    among: tuple = ()
    positive: bool = False
    feature: bool = False


#: The arrays and versions of both kinds of archives.
FIELDS = {
    "descriptors": (
        Field("descriptor_map", ("grid rows", "grid columns", "dimensions"), required=True, feature=True),
        Field("schema_version", among=(0, 1, 2)),
        Field("patch_size", positive=True),
        Field("proc_hw", (2,), positive=True),
        Field("orig_hw", (2,), positive=True),
    ),
    "keypoints": (
        Field("keypoints", ("points", 2), required=True, feature=True),
        Field("descriptors", ("points", "dimensions"), feature=True),
        Field("scores", ("points",), feature=True),
        Field("schema_version", among=(1,)),
        Field("proc_hw", (2,)),
        Field("orig_hw", (2,)),
    ),
}
#: The newest version of descriptor archives; what is older, or has none, is legacy.
NEWEST = 2


def problems(kind: str, arrays: Mapping[str, np.ndarray]) -> list[str]:
    """Everything that is wrong with an archive's arrays, by the table of its fields."""
    found, sizes = [], {}
    for field in FIELDS[kind]:
        if field.name not in arrays:
            found += [f"{field.name} is missing"] * field.required
            continue
        value = np.asarray(arrays[field.name])
        if field.feature:
            shape = value.shape
        else:
            shape, value = (() if value.size == 1 and not field.shape else (value.size,)), value.reshape(-1)
        wanted = tuple(sizes.setdefault(d, n) if isinstance(d, str) else d for d, n in zip(field.shape, shape, strict=False))
        if len(shape) != len(field.shape) or shape != wanted:
            found.append(f"{field.name} has the shape {shape}, not {field.shape}")
        elif field.among and int(value[0]) not in field.among:
            found.append(f"{field.name}: version {int(value[0])} cannot be read")
        elif field.positive and (value <= 0).any():
            found.append(f"{field.name} is not positive")
    return found


def provenance(kind: str, arrays: Mapping[str, np.ndarray]) -> dict[str, str]:
    """What is not an array of features, as text."""
    features = {f.name for f in FIELDS[kind] if f.feature}
    return {k: str(np.asarray(v).reshape(-1).tolist() if np.asarray(v).size != 1 else np.asarray(v).reshape(()).item()) for k, v in arrays.items() if k not in features}


class Unreadable(ValueError):
    """An archive that is not what its kind should be."""


def _require(found: list[str]) -> None:
    if found:
        raise Unreadable("; ".join(found))


def _header(file: zipfile.ZipFile, name: str) -> tuple:
    """The shape of an array of an archive, from its first bytes."""
    with file.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]


def load(kind: str, raw: bytes, vectors: bool = True) -> dict[str, np.ndarray]:
    """The arrays of an archive; without ``vectors`` those stand as empty views of their shape, and their numbers are not read."""
    heavy = {"descriptor_map", "descriptors"}
    with np.load(io.BytesIO(raw), allow_pickle=False) as loaded, zipfile.ZipFile(io.BytesIO(raw)) as file:
        return {k: np.broadcast_to(np.float32(0), _header(file, k)) if k in heavy and not vectors else loaded[k] for k in loaded.files}


def descriptor_rows(raw: bytes, patch_size: int, vectors: bool = True) -> tuple[dict, dict]:
    """(values of the archive, columns with one value for each patch inside the processed size)."""
    arrays = load("descriptors", raw, vectors)
    _require(problems("descriptors", arrays))
    number = lambda name, otherwise: [int(x) for x in np.asarray(arrays[name]).reshape(-1)] if name in arrays else otherwise
    grid, (patch,) = arrays["descriptor_map"], number("patch_size", [patch_size])
    proc = number("proc_hw", [grid.shape[0] * patch, grid.shape[1] * patch])
    rows, columns = (n // patch for n in proc)
    _require([f"proc_hw needs a grid of {rows} x {columns}, there are {grid.shape[0]} x {grid.shape[1]}"] * (rows > grid.shape[0] or columns > grid.shape[1]))
    orig = number("orig_hw", proc)
    head = {"patch_size": patch, "grid_h": rows, "grid_w": columns, "proc_h": proc[0], "proc_w": proc[1], "orig_h": orig[0], "orig_w": orig[1], "legacy": number("schema_version", [0])[0] < NEWEST, "meta": list(provenance("descriptors", arrays).items())}
    at = np.arange(rows * columns)
    body = {"patch_idx": at, "gx": at % max(columns, 1), "gy": at // max(columns, 1)}
    return head, body | ({"v": grid[:rows, :columns].reshape(len(at), -1).astype(np.float32)} if vectors else {})


def keypoint_rows(raw: bytes, _: int = 0, vectors: bool = True) -> tuple[dict, dict]:
    """(values of the archive, columns with one value for each point); one point without a number where there are none."""
    arrays = load("keypoints", raw, vectors)
    _require(problems("keypoints", arrays))
    head = {"legacy": "schema_version" not in arrays, "meta": list(provenance("keypoints", arrays).items())}
    xy = arrays["keypoints"].astype(np.float32)
    body = {"kp_idx": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}
    body |= {"score": arrays["scores"].astype(np.float32)} if "scores" in arrays else {}
    body |= {"v": arrays["descriptors"].astype(np.float32)} if "descriptors" in arrays and vectors else {}
    return head, body if len(xy) else {"kp_idx": None}


KINDS = {"descriptors": descriptor_rows, "keypoints": keypoint_rows}
#: The columns of both kinds: those with one value for an archive, then those of its rows.
SCHEMAS = {
    "descriptors": "path string, patch_size int, grid_h int, grid_w int, proc_h int, proc_w int, orig_h int, orig_w int, legacy boolean, meta map<string,string>, patch_idx int, gx int, gy int, v array<float>, problem string",
    "keypoints": "path string, legacy boolean, meta map<string,string>, kp_idx int, x float, y float, score float, v array<float>, problem string",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "float": pa.float32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<float>": pa.list_(pa.float32())}


def batch(kind: str, path: str, raw: bytes, patch_size: int = 16, columns: tuple[str, ...] = ()) -> pa.RecordBatch:
    """One archive as rows of its kind's schema (or of some columns of it); an unreadable one as one row with its problem."""
    kinds = dict(c.split(" ") for c in SCHEMAS[kind].split(", "))
    columns = columns or tuple(kinds)
    try:
        head, body = KINDS[kind](raw, patch_size, "v" in columns)
        head = head | {"path": path}
    except Exception as e:  # whatever is wrong with one archive is its own affair
        head, body = {"path": path, "problem": f"{type(e).__name__}: {e}"}, {next(c for c in ("patch_idx", "kp_idx") if c in kinds): None}
    size = max((1 if x is None else len(x) for x in body.values()), default=0)

    def column(name: str) -> pa.Array:
        value, target = body.get(name), _ARROW[kinds[name]]
        if name in head:
            return pa.array([head[name]] * size, target)
        if value is None:
            return pa.nulls(size, target)
        if value.ndim == 2:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(value) + 1) * value.shape[1], pa.int32()), pa.array(value.ravel()))
        return pa.array(value).cast(target)

    return pa.RecordBatch.from_arrays([column(c) for c in columns], names=list(columns))


# ---------------------------------------------------------------- the data source
def file_system(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class FeatureArchives(DataSource):
    """Options: ``path``; ``kind`` (descriptors or keypoints); ``patchSize``, for descriptor archives that lack it; ``partitionBytes``, the size of a partition's files.

    Written are rows (name string, content binary): each becomes ``<path>/<one folder for the job>/<name>.npz``.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "descriptors")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if sorted(schema.fieldNames()) != ["content", "name"]:
            raise ValueError("written are the columns name and content")
        return ArchiveWriter(self.options, overwrite)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: StructType):
        self.kind, self.path = options.get("kind", "descriptors"), options["path"]
        self.patch_size, self.bytes = int(options.get("patchSize", 16)), int(options.get("partitionBytes", 64 << 20))
        self.columns, self.filters = tuple(schema.fieldNames()), []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes filters on the path: equal, among, and with a beginning; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        tests = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value)}
        return all(tests[type(f)](f) for f in self.filters)

    def partitions(self) -> list[Files]:
        """The archives below the path, in order, dealt into partitions of about the same bytes; those of a name that begins with _ or . belong to a writer."""
        from pyarrow import fs

        system, top = file_system(self.path)
        prefix = self.path[: len(self.path) - len(top)] if self.path.endswith(top) else ""
        out, held, size = [], [], 0
        for info in sorted(system.get_file_info(fs.FileSelector(top, recursive=True)), key=lambda i: i.path):
            inner = info.path[len(top) :].strip("/").split("/")
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name.lower(), "*.npz") or any(p[0] in "_." for p in inner) or not self._wanted(prefix + info.path):
                continue
            if held and size + info.size > self.bytes:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(prefix + info.path)
            size += info.size
        return out + [Files(tuple(held))] * bool(held)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths if partition is not None else ():
            system, inner = file_system(path)
            with system.open_input_file(inner) as f:
                yield batch(self.kind, path, f.read(), self.patch_size, self.columns)


class ArchiveWriter(DataSourceArrowWriter):
    """Tasks write into a hidden folder of the job; the commit throws away what no message names (files of attempts that failed or were beaten), adds
    a manifest and renames the folder once, which is when all archives appear.  An abort deletes the folder."""

    def __init__(self, options: Mapping[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.hidden = f"{self.path}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        attempt, files = uuid.uuid4().hex, []
        system, hidden = file_system(self.hidden)
        system.create_dir(hidden, recursive=True)
        for rows in iterator:
            for name, content in zip(rows.column("name").to_pylist(), rows.column("content").to_pylist(), strict=True):
                if not name or "/" in name or name[0] in "_.":
                    raise ValueError(f"no name of a file: {name!r}")
                file = f"{name}.{attempt}"
                with system.open_output_stream(f"{hidden}/{file}") as out:
                    out.write(content)
                files.append(file)
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, hidden = file_system(self.hidden)
        system.create_dir(hidden, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        names = [f.rpartition(".")[0] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two archives of one name")
        for info in system.get_file_info(fs.FileSelector(hidden)):
            if info.base_name not in set(files):
                system.delete_file(info.path)
        for file, name in zip(files, names, strict=True):
            system.move(f"{hidden}/{file}", f"{hidden}/{name}.npz")
        with system.open_output_stream(f"{hidden}/_manifest.json") as out:
            out.write(json.dumps(sorted(names)).encode())
        top = file_system(self.path)[1]
        before = [i.path for i in system.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.Directory and not i.base_name.startswith("_")] if self.overwrite else []
        system.move(hidden, f"{top}/job-{self.job}")
        for folder in before:
            system.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, hidden = file_system(self.hidden)
        if system.get_file_info(hidden).type == fs.FileType.Directory:
            system.delete_dir(hidden)
