"""Episode stores as a Spark data source: a folder per episode, an array per signal, read and written by chunks.

The format is Zarr, version 3: a group document with the episode's attributes, and per array a document and its chunks. Reading,
a task takes blocks of episodes' frames and opens the chunks alone that hold them. Writing, an array's chunks go into one
shard; a task writes its episodes into a folder of its attempt, and the driver's commit moves whole episodes to their place
and then gives each its document, which marks it complete.

Files are reached by Arrow's file systems, so paths are local ones or URIs that Arrow knows (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import base64
import gzip
import itertools
import json
import math
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql import types as T

from ..constants import DEFAULT_FPS

__all__ = ["EpisodeStore", "read_arrays", "register_stores", "write_store"]

BLOBS = ("variable_length_bytes", "bytes")
NUMBERS = {"bool": "?", **{f"{a}int{8 * n}": f"{b}{n}" for a, b in (("", "i"), ("u", "u")) for n in (1, 2, 4, 8)}, **{f"float{8 * n}": f"f{n}" for n in (2, 4, 8)}}
DOCUMENT = "zarr.json"
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1)
    if "://" in path or path.startswith("file:"):
        at, root = fs.FileSystem.from_uri(path)
        return at, root.rstrip("/")
    return fs.LocalFileSystem(), path.rstrip("/")


def read_document(at, path: str) -> dict | None:
    """A JSON document; None where there is no file."""
    try:
        with at.open_input_file(path) as f:
            return json.loads(f.read())
    except (FileNotFoundError, NotADirectoryError):
        return None


def folders(at, path: str) -> list[str]:
    """The names of a folder's sub-folders, sorted; hidden ones and attempts are left out."""
    from pyarrow import fs

    found = at.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name[0] not in "._")


def episode_root(at, root: str) -> str:
    """The folder whose sub-folders hold group documents: the root itself, else the first of its sub-folders that is one."""

    def holds(path: str) -> bool:
        from pyarrow import fs

        some = folders(at, path)
        return any(at.get_file_info([f"{path}/{n}/{DOCUMENT}"])[0].type == fs.FileType.File for n in some)

    return next((p for p in (root, *(f"{root}/{n}" for n in folders(at, root))) if holds(p)), root)


class StoredArray:
    """One array: what its document says, and its chunks, each fetched when it is asked for.

    `opened` counts the chunks fetched. A chunk that isn't there holds the fill value, as the format has it.
    """

    def __init__(self, at, path: str, document: dict):
        self.at, self.path, self.opened = at, path, 0
        self.shape = document["shape"]
        self.kind = document["data_type"]
        self.separator = document.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        self.chunk = document["chunk_grid"]["configuration"]["chunk_shape"]
        self.codecs, self.shard, self.index_codecs, self.index_last = document["codecs"], None, [], True
        if self.codecs[0]["name"] == "sharding_indexed":
            own = self.codecs[0]["configuration"]
            self.shard, self.chunk, self.codecs = self.chunk, own["chunk_shape"], own["codecs"]
            self.index_codecs, self.index_last = own["index_codecs"], own.get("index_location", "end") == "end"
        self.fill = document.get("fill_value")
        self._shard: tuple[str, object, np.ndarray] | None = None  # the one read last: path, open file, index
        if self.kind not in NUMBERS and self.kind not in BLOBS:
            raise ValueError(f"{path}: arrays of {self.kind} are not read")

    @property
    def blobs(self) -> bool:
        return self.kind in BLOBS

    def _file(self, place: Sequence[int]) -> str:
        return f"{self.path}/c{self.separator}{self.separator.join(map(str, place))}" if place else f"{self.path}/c"

    def _fetch(self, place: tuple[int, ...]) -> bytes | None:
        """A chunk's bytes as stored; of a shard, its own bytes alone."""
        try:
            if not self.shard:
                with self.at.open_input_file(self._file(place)) as f:
                    self.opened += 1
                    return f.read()
            per = [s // c for s, c in zip(self.shard, self.chunk, strict=True)]
            path = self._file([p // n for p, n in zip(place, per, strict=True)])
            if not self._shard or self._shard[0] != path:
                self.close()
                f = self.at.open_input_file(path)
                size = 16 * math.prod(per) + 4 * sum(c["name"] == "crc32c" for c in self.index_codecs)
                raw = f.read_at(size, f.size() - size if self.index_last else 0)
                self._shard = path, f, np.frombuffer(raw[: 16 * math.prod(per)], "<u8").reshape(*per, 2)
            offset, n = self._shard[2][tuple(p % k for p, k in zip(place, per, strict=True))].tolist()
            if offset == n == 2**64 - 1:
                return None
            self.opened += 1
            return self._shard[1].read_at(n, offset)
        except FileNotFoundError:
            return None

    def close(self) -> None:
        if self._shard:
            self._shard[1].close()
            self._shard = None

    def _decoded(self, raw: bytes):
        """The values of a chunk: an array of its shape, or a list of bytes."""
        order = None
        for codec in reversed(self.codecs):
            name, own = codec["name"], codec.get("configuration") or {}
            if name == "zstd":
                import zstandard

                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            elif name == "gzip":
                raw = gzip.decompress(raw)
            elif name == "crc32c":
                raw = raw[:-4]
            elif name == "vlen-bytes":
                out, at = [], 4
                for _ in range(int.from_bytes(raw[:4], "little")):
                    n = int.from_bytes(raw[at : at + 4], "little")
                    out.append(raw[at + 4 : at + 4 + n])
                    at += 4 + n
                raw = out
            elif name == "bytes":
                raw = np.frombuffer(raw, np.dtype(NUMBERS[self.kind]).newbyteorder(">" if own.get("endian") == "big" else "<"))
            elif name == "transpose":
                order = own["order"]
            else:
                raise ValueError(f"{self.path}: unknown codec {name}")
        if self.blobs:
            return raw
        if order is None:
            return raw.reshape(self.chunk)
        return raw.reshape([self.chunk[k] for k in order]).transpose(np.argsort(order))

    def rows(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray | list[bytes]]]:
        """(first row, values) of the rows from low up to, without, high, chunk by chunk of the first dimension. Numbers
        come as doubles, a row of each."""
        high = min(high, self.shape[0])
        size = self.chunk[0]
        for c in range(low // size, -(-high // size) if high > low else low // size):
            a, b = max(low, c * size), min(high, (c + 1) * size)
            if self.blobs:
                raw = self._fetch((c,))
                fill = base64.b64decode(self.fill or "")
                yield a, self._decoded(raw)[a - c * size : b - c * size] if raw is not None else [fill] * (b - a)
                continue
            out = np.full((b - a, *self.shape[1:]), float(self.fill or 0))
            for rest in itertools.product(*(range(-(-n // k)) for n, k in zip(self.shape[1:], self.chunk[1:], strict=True))):
                raw = self._fetch((c, *rest))
                if raw is not None:
                    to = tuple(slice(r * k, min(n, (r + 1) * k)) for r, k, n in zip(rest, self.chunk[1:], self.shape[1:], strict=True))
                    got = self._decoded(raw)[(slice(a - c * size, b - c * size), *(slice(0, s.stop - s.start) for s in to))]
                    out[(slice(None), *to)] = got
            yield a, out.reshape(b - a, -1)


@dataclass
class Wanted:
    """What filters ask for: names (None: all) and rows from first up to, without, last."""

    episodes: set[str] | None = None
    arrays: set[str] | None = None
    first: int = 0
    last: float = math.inf

    def take(self, f: Filter) -> bool:
        """Narrows to what a filter lets through; false if it can't be told here."""
        match f:
            case EqualTo(("episode" | "array" as name,), value):
                values = {value}
            case In(("episode" | "array" as name,), values):
                values = set(values)
            case EqualTo(("frame_idx",), value):
                self.first, self.last = max(self.first, value), min(self.last, value + 1)
                return True
            case GreaterThan(("frame_idx",), value):
                self.first = max(self.first, value + 1)
                return True
            case GreaterThanOrEqual(("frame_idx",), value):
                self.first = max(self.first, value)
                return True
            case LessThan(("frame_idx",), value):
                self.last = min(self.last, value)
                return True
            case LessThanOrEqual(("frame_idx",), value):
                self.last = min(self.last, value + 1)
                return True
            case IsNotNull(("episode" | "array" | "frame_idx",)):
                return True
            case _:
                return False
        own = self.episodes if name == "episode" else self.arrays
        setattr(self, f"{name}s", values if own is None else own & values)
        return True


@dataclass
class Block:
    """Frames from `low` up to, without, `high` of the episode in a folder."""

    folder: str
    episode: str
    low: int
    high: int


@dataclass
class Blocks(InputPartition):
    """What a task reads: blocks of long episodes, or several short ones together."""

    blocks: list[Block]


class EpisodeReader(DataSourceReader):
    """(episode, array, frame_idx, value): a row per frame and array, the frames up to the episode's total_frames.

    The driver lists the episodes that filters leave and reads their group documents. An episode is cut into blocks of
    frames_a_task. Blocks share a partition where there would be more than `most_partitions` of them, and short episodes do as
    long as there are `least_partitions`: tasks stream them, so their number grows no further with the store. Array documents,
    shard indexes and chunks are read in the tasks. Values "documents" gives (episode, document) instead, which tasks read.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.block, self.least = options["path"], int(options.get("frames_a_task", 20_000)), int(options.get("least_partitions", 64))
        self.most = int(options.get("most_partitions", 1024))
        self.blobs, self.documents = (options.get("values", "numbers") == v for v in ("blobs", "documents"))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> Sequence[Blocks]:
        at, root = file_system(self.path)
        root = episode_root(at, root)
        names = [n for n in folders(at, root) if self.wanted.episodes is None or n in self.wanted.episodes]
        if self.documents:
            n = max(1, -(-len(names) // self.least), -(-len(names) // self.most))
            return [Blocks([Block(f"{root}/{e}", e, 0, 0) for e in names[k : k + n]]) for k in range(0, max(1, len(names)), n)]
        with ThreadPoolExecutor(32) as pool:
            documents = list(pool.map(lambda n: read_document(at, f"{root}/{n}/{DOCUMENT}"), names))
        blocks = []
        for name, document in zip(names, documents, strict=True):
            n = int(min(int((document or {}).get("attributes", {}).get("total_frames") or 0), self.wanted.last))
            blocks += [Block(f"{root}/{name}", name, max(low, self.wanted.first), min(low + self.block, n)) for low in range(self.wanted.first // self.block * self.block, n, self.block)]
        total = sum(b.high - b.low for b in blocks)
        enough = max(min(self.block, -(-total // self.least)), -(-total // self.most))
        out, held = [Blocks([])], 0
        for b in blocks:
            if held >= enough:
                out.append(Blocks([]))
                held = 0
            last = out[-1].blocks[-1] if out[-1].blocks else None
            if last and (last.folder, last.high) == (b.folder, b.low):
                last.high = b.high
            else:
                out[-1].blocks.append(b)
            held += b.high - b.low
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        """The blocks' rows, small batches joined."""
        held, rows, size = [], 0, 0
        at, _ = file_system(self.path)
        of = self._documents(at, partition.blocks) if self.documents else (b for block in partition.blocks for b in self._read(at, block))
        for batch in of:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows, size = [], 0, 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _documents(self, at, blocks: Sequence[Block]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            try:
                with at.open_input_file(f"{b.folder}/{DOCUMENT}") as f:
                    text = f.read().decode(errors="replace")
            except (FileNotFoundError, NotADirectoryError):
                continue
            yield pa.RecordBatch.from_arrays([pa.array([b.episode]), pa.array([text])], names=["episode", "document"])

    def _batch(self, episode: str, array: str, first: int, parts: list) -> pa.RecordBatch:
        if self.blobs:
            values = [v for p in parts for v in p]
            column = pa.array(values, pa.binary())
        else:
            values = np.concatenate(parts)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([episode] * n, pa.string()), pa.array([array] * n, pa.string()), pa.array(np.arange(first, first + n)), column], names=["episode", "array", "frame_idx", "value"])

    def _read(self, at, block: Block) -> Iterator[pa.RecordBatch]:
        for name in folders(at, block.folder):
            if self.wanted.arrays is not None and name not in self.wanted.arrays:
                continue
            document = read_document(at, f"{block.folder}/{name}/{DOCUMENT}")
            if document is None or document.get("node_type") != "array" or (document["data_type"] in BLOBS) != self.blobs:
                continue
            array = StoredArray(at, f"{block.folder}/{name}", document)
            parts, began, size = [], 0, 0
            for first, values in array.rows(block.low, block.high):
                began = began if parts else first
                parts.append(values)
                size += sum(map(len, values)) if self.blobs else values.nbytes
                if size >= BATCH_BYTES:
                    yield self._batch(block.episode, name, began, parts)
                    parts, size = [], 0
            array.close()
            if parts:
                yield self._batch(block.episode, name, began, parts)


class Shard:
    """An array's file: chunks as they come, and behind them their index."""

    def __init__(self, at, path: str):
        self.file, self.index, self.end = at.open_output_stream(path, compression=None), [], 0

    def add(self, chunk: bytes) -> None:
        self.file.write(chunk)
        self.index += [self.end, len(chunk)]
        self.end += len(chunk)

    def close(self) -> None:
        self.file.write(np.array(self.index, "<u8").tobytes())
        self.file.close()


class StoredEpisode:
    """An episode being written: chunks of blobs as they come, numbers when all rows are there."""

    def __init__(self, at, folder: str, schema: pa.Schema, order: str, key: str, attributes: Sequence[str], chunk: int):
        self.at, self.folder, self.order, self.chunk = at, folder, order, chunk
        self.attributes: dict = {}
        self.constant = [n for n in schema.names if n in attributes]
        self.blobs = {n: [] for n in schema.names if n not in (key, order, *attributes) and (pa.types.is_binary(schema.field(n).type) or pa.types.is_large_binary(schema.field(n).type))}
        self.numbers = {n: [] for n in schema.names if n not in (key, order, *attributes) and n not in self.blobs}
        self.frames: list[int] = []
        self.shards: dict[str, Shard] = {}

    def _write(self, path: str, data: bytes) -> None:
        with self.at.open_output_stream(path, compression=None) as f:
            f.write(data)

    def _put(self, name: str, place: str, data: bytes) -> None:
        """Adds a chunk to the array's shard, the one of that place."""
        import zstandard

        if name not in self.shards:
            self.at.create_dir(f"{self.folder}/{name}", recursive=True)
            self.shards[name] = Shard(self.at, f"{self.folder}/{name}/c.{place}")
        self.shards[name].add(zstandard.ZstdCompressor(level=1).compress(data))

    def _flush(self, name: str) -> None:
        own = self.blobs[name]
        parts = [len(own).to_bytes(4, "little"), *(x for b in own for x in (len(b).to_bytes(4, "little"), b))]
        self._put(name, "0", b"".join(parts))
        own.clear()

    def add(self, row: dict) -> None:
        """A row; an error if one of its blobs is null."""
        if not self.frames:
            self.attributes = {n: row[n] for n in self.constant if row[n] is not None}
        for name in self.blobs:
            if row[name] is None:
                raise ValueError(f"frame {row[self.order]} has no {name}")
        self.frames.append(row[self.order])
        for name, own in self.blobs.items():
            own.append(row[name])
            if len(own) == self.chunk:
                self._flush(name)
        for name, own in self.numbers.items():
            own.append(row[name])

    def _document(self, name: str, kind: str, shape: list[int], chunk: list[int], fill, codec: dict) -> None:
        little = {"name": "bytes", "configuration": {"endian": "little"}}
        inner = {"chunk_shape": chunk, "codecs": [codec, {"name": "zstd", "configuration": {"level": 1, "checksum": False}}], "index_codecs": [little], "index_location": "end"}
        codecs = [{"name": "sharding_indexed", "configuration": inner}]
        shard = [-(-shape[0] // chunk[0]) * chunk[0], *chunk[1:]]
        grid, keys = {"name": "regular", "configuration": {"chunk_shape": shard}}, {"name": "default", "configuration": {"separator": "."}}
        self.shards[name].close()
        self._write(f"{self.folder}/{name}/{DOCUMENT}", json.dumps({"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "chunk_grid": grid, "chunk_key_encoding": keys, "fill_value": fill, "codecs": codecs, "attributes": {}}).encode())

    def finish(self) -> None:
        """What is left, the documents, and last the group's, by a hidden name until the episode is in its place. Rows of numbers
        shorter than the longest are filled up with NaN; a column without any number gives no array."""
        n = len(self.frames)
        self.at.create_dir(self.folder, recursive=True)
        for name, own in self.blobs.items():
            if own:
                self._flush(name)
            self._document(name, BLOBS[0], [n], [self.chunk], "", {"name": "vlen-bytes"})
        for name, own in self.numbers.items():
            rows = [x if isinstance(x, list) else [] if x is None else [x] for x in own]
            width = max(map(len, rows))
            if not width:
                continue
            data = np.full((n, width), np.nan)
            for k, x in enumerate(rows):
                data[k, : len(x)] = [np.nan if v is None else v for v in x]
            flat = not any(isinstance(x, list) for x in own)
            for k in range(0, n, self.chunk):
                part = np.full((self.chunk, width), np.nan)
                part[: min(self.chunk, n - k)] = data[k : k + self.chunk]
                self._put(name, "0" if flat else "0.0", part.astype("<f8").tobytes())
            self._document(name, "float64", [n] if flat else [n, width], [self.chunk] if flat else [self.chunk, width], "NaN", {"name": "bytes", "configuration": {"endian": "little"}})
        step = self.frames[1] - self.frames[0] if n > 1 else DEFAULT_FPS
        own = {"total_frames": n, "fps": DEFAULT_FPS / max(1, step), "source_frames": self.frames}
        self._write(f"{self.folder}/.{DOCUMENT}", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": own | self.attributes | {"complete": True}}).encode())


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, the episodes in it that are whole, and the faults of the others."""

    folder: str
    episodes: list[str]
    faults: dict[str, str] = field(default_factory=dict)


class EpisodeWriter(DataSourceArrowWriter):
    """Rows that come sorted by episode and frame, an episode in one task alone.

    An episode with a fault (a blob that is null, a name that is no folder's) is left out and stops no other of its task; the
    commit places and marks the others and then fails, naming it. A task that fails leaves its attempt's folder to the driver,
    which on abort places what the tasks that ended had written, marks it, and deletes the rest.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.key, self.order, self.chunk = options.get("key", "episode"), options.get("order", "frame_idx"), int(options.get("chunk", 256))
        self.attributes = [a for a in options.get("attributes", "").split(",") if a]
        self.strict = options.get("strict", "true") == "true"

    def _attempts(self, root: str) -> str:
        return f"{root}/_attempt-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at, root = file_system(self.path)
        out, now, open_ = Written(f"{self._attempts(root)}/{uuid.uuid4().hex}", []), None, None

        def close() -> None:
            if open_ is not None and now not in out.faults:
                open_.finish()
                out.episodes.append(now)
            elif open_ is not None:
                for shard in open_.shards.values():
                    shard.file.close()

        for batch in iterator:
            for row in batch.to_pylist():
                episode = str(row[self.key])
                if open_ is None or episode != now:
                    close()
                    now = episode
                    open_ = StoredEpisode(at, f"{out.folder}/{episode}", batch.schema, self.order, self.key, self.attributes, self.chunk)
                    if "/" in episode or episode[:1] in (".", "_", ""):
                        out.faults[episode] = "its name can't be a folder's"
                if episode not in out.faults:
                    try:
                        open_.add(row)
                    except ValueError as e:
                        out.faults[episode] = str(e)
        close()
        return out

    def _place(self, messages: Sequence[Written | None]) -> dict[str, str]:
        """Moves whole episodes to their place and gives them their documents; the faults of the others."""
        from pyarrow import fs

        at, root = file_system(self.path)
        faults, seen = {}, {}
        for m in messages:
            for episode in m.episodes if m else ():
                seen[episode] = seen.get(episode, 0) + 1
            faults |= m.faults if m else {}
        faults |= {e: "it came in several tasks" for e, n in seen.items() if n > 1}
        there = {f.base_name for f in at.get_file_info(fs.FileSelector(root, allow_not_found=True))}

        def place(one: tuple[str, str]) -> None:
            source, target = f"{one[0]}/{one[1]}", f"{root}/{one[1]}"
            if one[1] in there:
                if at.get_file_info([source])[0].type == fs.FileType.NotFound:  # an earlier call has moved it
                    return
                at.delete_dir(target)
            at.move(source, target)
            at.move(f"{target}/.{DOCUMENT}", f"{target}/{DOCUMENT}")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(place, ((m.folder, e) for m in messages if m for e in m.episodes if e not in faults)))
        if folders(at, root) or any(m for m in messages):
            at.create_dir(root, recursive=True)
        at.create_dir(self._attempts(root), recursive=True)
        at.delete_dir(self._attempts(root))
        return faults

    def commit(self, messages: list[Written | None]) -> None:
        at, root = file_system(self.path)
        before = set(folders(at, root)) if self.overwrite else set()
        faults = self._place(messages)
        for name in before.difference(e for m in messages if m for e in m.episodes):
            at.delete_dir(f"{root}/{name}")
        if faults and self.strict:
            raise ValueError("episodes not written: " + "; ".join(f"{e}: {why}" for e, why in sorted(faults.items())))

    def abort(self, messages: list[Written | None]) -> None:
        self._place(messages)


class EpisodeStore(DataSource):
    """format("episode_store"). Reading, option values is numbers (arrays of doubles), blobs or documents (the groups');
    frames_a_task bounds a block, most_partitions how many tasks read them. Writing, options key, order, attributes (comma-separated), chunk (rows of a chunk) and strict (whether faults of
    episodes fail the write)."""

    @classmethod
    def name(cls) -> str:
        return "episode_store"

    def schema(self) -> str:
        return f"episode string, array string, frame_idx bigint, value {'binary' if self.options.get('values') == 'blobs' else 'array<double>'}" if self.options.get("values") != "documents" else "episode string, document string"

    def reader(self, schema: T.StructType) -> EpisodeReader:
        return EpisodeReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> EpisodeWriter:
        out = EpisodeWriter(dict(self.options), overwrite)
        for f in schema.fields:
            kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if f.name not in (out.key, out.order, *out.attributes) and not isinstance(kind, (T.NumericType, T.BooleanType)) and not isinstance(f.dataType, T.BinaryType):
                raise ValueError(f"column {f.name} is neither bytes nor numbers; should it be an attribute?")
        return out


def register_stores(spark: SparkSession) -> None:
    """Makes format("episode_store") known to a session, and lets its readers see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpisodeStore)


def read_arrays(spark: SparkSession, root: str, *, blobs: bool = False, frames_a_task: int = 20_000) -> DataFrame:
    """(episode, array, frame_idx, value) of a store's arrays: rows of doubles, whatever their shape and type, or of bytes.
    Filters by episode, array and frame_idx decide what is opened. A store without episodes has no rows."""
    register_stores(spark)
    return spark.read.format("episode_store").option("values", "blobs" if blobs else "numbers").option("frames_a_task", str(frames_a_task)).load(root)


def write_store(frames: DataFrame, root: str, *, key: str = "episode", order: str = "frame_idx", attributes: Sequence[str] = (), chunk: int = 256, overwrite: bool = False, strict: bool = True) -> None:
    """Writes a row per frame as a store: binary columns as arrays of bytes, numbers and arrays of numbers as arrays of
    doubles. Attribute columns are taken from an episode's first row; total_frames, source_frames and fps are added.

    Episodes in the rows replace those of their name; the others stay unless overwrite is set. read_episode_store() tells which
    are complete, and loading.skip_completed() leaves them out. An episode with a fault isn't written; once the others are
    complete, the write fails for it, or not if not strict.
    """
    register_stores(frames.sparkSession)
    rows = frames.repartition(key).sortWithinPartitions(key, order)
    options = {"key": key, "order": order, "attributes": ",".join(attributes), "chunk": str(chunk), "strict": str(strict).lower()}
    rows.write.format("episode_store").options(**options).mode("overwrite" if overwrite else "append").save(root)
