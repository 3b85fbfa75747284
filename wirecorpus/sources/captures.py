"""Capture files as a Spark data source: ``spark.read.format("capture")``.

Large files are cut into splits and small files share an input partition, so neither a capture
that holds most frames nor a folder of many tiny captures decides the number of tasks. A split that
starts inside a file first finds a record boundary; ``read_captures`` checks that the records of all
splits join up, so a wrong boundary is an error and never a wrong row. A capture may be a folder of
parts, which are read as one. Paths are local or any URI that Arrow can open.

Neither the names of captures nor anything else that grows with their number passes through the driver:
folders are listed in tasks, which leave lists of splits in the shared folder for the tasks that read
them, and what a writing task has made is told by a list of its own.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage,
)

from wirecorpus.functions.octets import quotient
from wirecorpus.session import stage, staged_path

# fixed values: file magic by byte order and time resolution (nanoseconds per unit of the fraction)
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000),
    b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1),
}
FILE_HEADER, RECORD_HEADER = 24, 16
MAX_FRAME_OCTETS = 262_144
# fixed values: link types of file headers. Raw IP has three numbers; cooked captures have a header
# of their own in front of the network header
ETHERNET, RAW_IP, COOKED = 1, 101, 113
LINK_TYPES = {1: ETHERNET, 12: RAW_IP, 14: RAW_IP, 101: RAW_IP, 113: COOKED}
ROWS_PER_BATCH = 2048
BATCH_OCTETS = 8 * 1024 * 1024
PART_NAME = re.compile(r"part-(\d+)\.pcap")
MANIFEST_NAME = re.compile(r"\.captures-(\w+)\.json")
# folders of lists and of parts without their names
OWN_FOLDER = re.compile(r"\.captures-[0-9a-f]{32}|\.[0-9a-f]{32}-[0-9a-f]{32}")
# files that a task renames when a job is done, and tasks for that and for listing folders
RENAMES = 4096
LISTING_TASKS = 1024
DEFAULT_SPLIT_OCTETS = 128 * 1024 * 1024
# opening a file counts as this part of a split: many small captures are read one after another by a task
OPEN_COST_SHARE = 2048
READ_OCTETS = 4 * 1024 * 1024
# offsets of the parts of a capture are this far apart
PART_OCTETS = 1 << 40
# splits whose counts may be handed to every task; beyond it they are joined like any table
SHARED_SPLITS = 200_000

RAW_SCHEMA = (
    "capture STRING, label STRING, super_label STRING, start BIGINT, offset BIGINT, ordinal BIGINT, file_end BIGINT, ts_ns BIGINT, "
    "cap_len INT, wire_len INT, frame BINARY, truncated BOOLEAN, link_type INT"
)
# one row per split, without its frames
COUNT_SCHEMA = "capture STRING, start BIGINT, n BIGINT, first BIGINT, behind BIGINT, file_end BIGINT"
ARROW_SCHEMA = pa.schema([
    ("capture", pa.string()), ("label", pa.string()), ("super_label", pa.string()),
    ("start", pa.int64()), ("offset", pa.int64()), ("ordinal", pa.int64()), ("file_end", pa.int64()), ("ts_ns", pa.int64()),
    ("cap_len", pa.int32()), ("wire_len", pa.int32()), ("frame", pa.binary()), ("truncated", pa.bool_()),
    ("link_type", pa.int32()),
])
ARROW_COUNTS = pa.schema([
    ("capture", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("behind", pa.int64()),
    ("file_end", pa.int64()),
])


def _filesystem(root: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in root:
        store, path = arrow_fs.FileSystem.from_uri(root)
        return store, path.rstrip("/")
    return arrow_fs.LocalFileSystem(), os.path.abspath(root)


class FileSplit:
    """``base`` is the place of the file among the parts of its capture, added to all offsets."""

    def __init__(
        self, path: str, capture: str, label: str, super_label: str | None, start: int, end: int, size: int, base: int,
    ):
        self.path, self.capture, self.label, self.super_label = path, capture, label, super_label
        self.start, self.end, self.size, self.base = start, end, size, base


class SplitGroup(InputPartition):
    """Splits read one after another by a task, or the files that list them."""

    def __init__(self, splits: list[FileSplit], lists: list[str] | None = None):
        self.splits, self.lists = splits, lists


def _cost(split: FileSplit, octets: int) -> int:
    """Octets of a split; opening a file costs as much as a part of a full one."""
    return split.end - split.start + octets // OPEN_COST_SHARE


def _grouped(items: Iterable[tuple], octets: int) -> Iterator[list]:
    """Successive items, given with their costs, in groups of up to ``octets``."""
    group: list = []
    room = octets
    for item, cost in items:
        if group and cost > room:
            yield group
            group, room = [], octets
        group.append(item)
        room -= cost
    if group:
        yield group


def _record(head: bytes, order: str) -> tuple[int, int, int, int]:
    return struct.unpack(order + "IIII", head)


def _frame_limit(snaplen: int) -> int:
    """Most octets of a frame: what the file declares, and what is usual where it declares less."""
    return max(snaplen, MAX_FRAME_OCTETS)


def _plausible(head: bytes, order: str, unit: int, snaplen: int) -> int | None:
    """Length of the frame behind a record header, or None when it cannot be one."""
    if len(head) < RECORD_HEADER:
        return None
    _, fraction, cap, wire = _record(head, order)
    limit = _frame_limit(snaplen)
    if cap > (snaplen or limit) or cap > wire or wire > limit or wire == 0 or fraction * unit >= 1_000_000_000:
        return None
    return cap


def _next_boundary(f, start: int, size: int, order: str, unit: int, snaplen: int) -> int:
    """First position at or after ``start`` from which records follow one another."""
    at = start
    while at < size:
        f.seek(at)
        window = f.read(1 << 20)
        for i in range(max(len(window) - RECORD_HEADER + 1, 0)):
            if _plausible(window[i:i + RECORD_HEADER], order, unit, snaplen) is None:
                continue
            if _follows(f, at + i, size, order, unit, snaplen):
                return at + i
        if len(window) < RECORD_HEADER:
            return size
        at += len(window) - RECORD_HEADER + 1
    return size


def _follows(f, at: int, size: int, order: str, unit: int, snaplen: int) -> bool:
    # over more than any frame, so that a capture carried inside a frame is not taken for the file's
    # own records
    enough = at + 2 * _frame_limit(snaplen)
    while at < enough:
        if at == size:
            return True
        f.seek(at)
        cap = _plausible(f.read(RECORD_HEADER), order, unit, snaplen)
        if cap is None or at + RECORD_HEADER + cap > size:
            return False
        at += RECORD_HEADER + cap
    return True


class Manifests:
    """Which files of a folder are captures of committed jobs.

    A job's manifest names the lists of its tasks, with the captures in the order of the parts they were
    written to. It is put in place by one rename, which is the commit; only then are the parts given the
    names of their captures. A manifest that replaces makes those before it void, and their files are not
    read any more. A manifest may also list (part, capture) itself.
    """

    def __init__(self, store: arrow_fs.FileSystem, root: str) -> None:
        self.store, self.root = store, root
        top = store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        # a folder of parts goes when all of them have their names
        self.top = {i.base_name for i in top if OWN_FOLDER.fullmatch(i.base_name) or i.type == arrow_fs.FileType.File}
        listed = []
        for name in filter(MANIFEST_NAME.fullmatch, self.top):
            with store.open_input_stream(f"{root}/{name}") as f:
                listed.append(json.loads(f.read()) | {"job": MANIFEST_NAME.fullmatch(name)[1]})
        listed.sort(key=lambda m: (m["number"], m["job"]))
        self.last = max((m["number"] for m in listed), default=0)
        since = max((k for k, m in enumerate(listed) if m["replaces"]), default=0)
        self.void, self.live = listed[:since], listed[since:]

    def lists(self, manifest: dict) -> list[str | None]:
        """Names of the lists of a job's tasks, and None for what its manifest lists itself."""
        return [None] * bool(manifest["files"]) + [token for token, _ in manifest.get("lists", [])]

    def entries(self, manifest: dict, token: str | None, since: int = 0, until: int | None = None) -> Iterator[tuple[str, str]]:
        """(part, capture) of a list."""
        if token is None:
            yield from islice(map(tuple, manifest["files"]), since, until)
            return
        with self.store.open_input_stream(f"{self.root}/.captures-{manifest['job']}/.{token}.json") as f:
            lines = io.TextIOWrapper(io.BufferedReader(f, READ_OCTETS), "utf-8")
            for k, line in islice(enumerate(lines), since, until):
                yield f".{manifest['job']}-{token}/.{k}.part", json.loads(line)

    def waiting_lists(self) -> list[tuple[dict, str | None]]:
        """Lists of committed parts that may not have their names yet."""
        return [
            (m, t) for m in self.live for t in self.lists(m)
            if (any(part in self.top for part, _ in m["files"]) if t is None else f".{m['job']}-{t}" in self.top)]

    def waiting(self, inside: str) -> dict[str, arrow_fs.FileInfo]:
        """Files that have not been given their names yet, by captures of a folder."""
        found = {}
        for manifest, token in self.waiting_lists():
            mine = [(p, c) for p, c in self.entries(manifest, token) if c.startswith(inside)]
            there = self.store.get_file_info([f"{self.root}/{p}" for p, _ in mine])
            found |= {c: i for (_, c), i in zip(mine, there) if i.type == arrow_fs.FileType.File}
        return found

    def gone(self, inside: str) -> set[str]:
        """Captures of a folder that only void manifests list."""
        mine = lambda manifests: {
            c for m in manifests for t in self.lists(m) for _, c in self.entries(m, t) if c.startswith(inside)}
        return mine(self.void) - mine(self.live) if self.void else set()

    def commit(self, job: str, replaces: bool, files: list[tuple[str, str]], lists: list[tuple[str, int]] = ()) -> None:
        body = {"number": self.last + 1, "replaces": replaces, "files": [[os.path.basename(p), c] for p, c in files]}
        path = f"{self.root}/.captures-{job}.json"
        with self.store.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(body | {"lists": [list(x) for x in lists]}).encode())
        self.store.move(f"{path}.new", path)

    def name_parts(self, manifest: dict, token: str, since: int, until: int) -> None:
        """Give parts of a list the names of their captures; one that has it already is passed over."""
        folders = set()
        for part, capture in self.entries(manifest, token, since, until):
            path = f"{self.root}/{capture}"
            if (folder := os.path.dirname(path)) not in folders:
                self.store.create_dir(folder, recursive=True)
                folders.add(folder)
            try:
                self.store.move(f"{self.root}/{part}", path)
            except FileNotFoundError:
                if self.store.get_file_info(path).type != arrow_fs.FileType.File:
                    raise

    def delete(self, captures: list[str]) -> None:
        for info in self.store.get_file_info([f"{self.root}/{c}" for c in captures]):
            if info.type != arrow_fs.FileType.NotFound:
                self.store.delete_file(info.path)

    def drop_void(self) -> None:
        """Delete void manifests; their files must be gone."""
        for manifest in self.void:
            self.store.delete_file(f"{self.root}/.captures-{manifest['job']}.json")
            if f".captures-{manifest['job']}" in self.top:
                self.store.delete_dir(f"{self.root}/.captures-{manifest['job']}")


def _folders(store: arrow_fs.FileSystem, root: str, levels: int, manifests: Manifests) -> list[str]:
    """Folders ``levels`` deep, which captures are in; those of parts without their names too."""
    found = [""]
    for _ in range(levels):
        found = [
            f"{folder}{i.base_name}/" for folder in found
            for i in store.get_file_info(arrow_fs.FileSelector(f"{root}/{folder}".rstrip("/")))
            if i.type == arrow_fs.FileType.Directory and not OWN_FOLDER.fullmatch(i.base_name)]
    waiting = {"/".join(c.split("/")[:levels]) + "/" for m, t in manifests.waiting_lists() for _, c in manifests.entries(m, t)}
    return sorted(waiting.union(found))


def _files_in(store: arrow_fs.FileSystem, folder: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the files of a folder and of those below; a local one is never held whole."""
    if not isinstance(store, arrow_fs.LocalFileSystem):
        chosen = arrow_fs.FileSelector(folder, allow_not_found=True, recursive=True)
        yield from ((i.path, i.size) for i in store.get_file_info(chosen) if i.type == arrow_fs.FileType.File)
        return
    try:
        entries = os.scandir(folder)
    except FileNotFoundError:
        return
    with entries:
        for entry in entries:
            if entry.is_dir():
                yield from _files_in(store, entry.path)
            elif entry.is_file():
                try:
                    yield entry.path, entry.stat().st_size
                except FileNotFoundError:  # it went meanwhile
                    continue


def _captures_in(
    store: arrow_fs.FileSystem, root: str, folder: str, levels: int, octets: int, manifests: Manifests,
) -> Iterator[list[FileSplit]]:
    """Splits of each capture of a folder, whose name ends in a slash."""
    # a part that has not been given its name yet stands for its capture; looked for first, since it may get it now
    waiting, gone = manifests.waiting(folder), manifests.gone(folder)
    named = ((path[len(root):].lstrip("/"), size) for path, size in _files_in(store, f"{root}/{folder}".rstrip("/")))
    found = [(name, size) for name, size in named if name not in waiting] + [(name, i.size) for name, i in waiting.items()]
    found.sort()
    for capture, files in groupby(found, lambda f: "/".join(f[0].split("/")[: levels + 1])):
        splits = []
        for name, size in files:
            parts = name.split("/")
            if parts[-1].startswith(".") or name in gone:
                continue
            part = PART_NAME.fullmatch(parts[-1]) if len(parts) == levels + 2 else None
            if len(parts) != levels + 1 and part is None:
                continue
            path, base = waiting[name].path if name in waiting else f"{root}/{name}", int(part[1]) * PART_OCTETS if part else 0
            label, top = parts[levels - 1], parts[0].lower() if levels == 2 else None
            for start in range(0, max(size, 1), octets):
                splits.append(FileSplit(path, capture, label, top, start, min(start + octets, size), size, base))
        if splits:
            yield splits


class CaptureReader(DataSourceReader):
    """Reads what ``lists`` names, or where there are none, what the driver finds in the folders itself."""

    def __init__(
        self, root: str, levels: int, split_octets: int, counts: bool = False, names: list[str] | None = None,
        several: bool = False, lists: str | None = None,
    ):
        self.root, self.levels, self.split_octets, self.counts, self.names = root, levels, split_octets, counts, names
        self.several, self.lists = several, lists

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("label",):
                self.names = [f.value] if self.names is None else [n for n in self.names if n == f.value]
            # the filter stays in the plan as well: pushing only prunes files
            yield f

    def partitions(self) -> list[InputPartition]:
        wanted = lambda label, several: (self.names is None or label in self.names) and (several or not self.several)
        if self.lists:
            index = [(name, cost) for name, label, cost, several in _read_json(self.lists, "index") if wanted(label, several)]
            return [SplitGroup([], names) for names in _grouped(index, self.split_octets)] or [SplitGroup([])]
        store, root = _filesystem(self.root)
        manifests = Manifests(store, root)
        splits = [
            (s, _cost(s, self.split_octets)) for folder in _folders(store, root, self.levels, manifests)
            for found in _captures_in(store, root, folder, self.levels, self.split_octets, manifests)
            for s in found if wanted(s.label, len(found) > 1)]
        return [SplitGroup(group) for group in _grouped(splits, self.split_octets)] or [SplitGroup([])]

    def read(self, partition: SplitGroup) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self.root)
        listed = (FileSplit(*s) for name in partition.lists or [] for s in _read_json(self.lists, name))
        schema = ARROW_COUNTS if self.counts else ARROW_SCHEMA
        rows: list[tuple] = []
        octets = 0
        # captures share batches: most have a few frames
        for split in (*partition.splits, *listed):
            if not split.size:
                continue
            with self._input(files, split) as f:
                for row in (self._counts if self.counts else self._records)(f, split):
                    rows.append(row)
                    octets += 0 if self.counts else row[8]
                    if len(rows) >= ROWS_PER_BATCH or octets >= BATCH_OCTETS:
                        yield self._batch(rows, schema)
                        rows, octets = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _input(files: arrow_fs.FileSystem, split: FileSplit):
        file = files.open_input_file(split.path)
        if split.start or split.end < split.size or split.size > READ_OCTETS:
            return io.BufferedReader(file, READ_OCTETS)
        with file:
            return io.BytesIO(file.read())

    def _open(self, f, partition: FileSplit) -> tuple[str, int, int, int]:
        """Byte order, time unit, snap length and link type of a file."""
        head = f.read(FILE_HEADER)
        if head[:4] not in MAGIC or len(head) < FILE_HEADER:
            raise ValueError(f"not a capture file: {partition.capture}")
        order, unit = MAGIC[head[:4]]
        snaplen, link = struct.unpack(order + "II", head[16:24])
        # the upper bits tell of a checksum at the end of frames
        if link & 0xFFFF not in LINK_TYPES:
            raise ValueError(f"link type {link & 0xFFFF} of {partition.capture} is not decoded")
        return order, unit, snaplen, LINK_TYPES[link & 0xFFFF]

    def _counts(self, f, partition: FileSplit) -> Iterator[tuple]:
        """How many records begin in a split, where its first one is and where the last one ends."""
        order, unit, snaplen, _ = self._open(f, partition)
        at = FILE_HEADER if partition.start == 0 else _next_boundary(
            f, max(partition.start, FILE_HEADER), partition.size, order, unit, snaplen)
        first, n = at, 0
        f.seek(at)
        while at < partition.end:
            head = f.read(RECORD_HEADER)
            cap = _record(head, order)[2] if len(head) == RECORD_HEADER else 0
            if cap > _frame_limit(snaplen):
                raise ValueError(f"broken record at octet {at} of {partition.capture}")
            if len(head) < RECORD_HEADER or at + RECORD_HEADER + cap > partition.size:
                at = partition.size  # a record that is cut off reaches the end of the file
                break
            f.seek(cap, io.SEEK_CUR)
            at, n = at + RECORD_HEADER + cap, n + 1
        if at > first:
            base = partition.base
            yield partition.capture, base + partition.start, n, base + first, base + at, base + partition.size

    def _records(self, f, partition: FileSplit) -> Iterator[tuple]:
        ordinal = 0
        order, unit, snaplen, link = self._open(f, partition)
        at = FILE_HEADER if partition.start == 0 else _next_boundary(
            f, max(partition.start, FILE_HEADER), partition.size, order, unit, snaplen)
        f.seek(at)
        while at < partition.end:
            head = f.read(RECORD_HEADER)
            seconds, fraction, cap, wire = _record(head, order) if len(head) == RECORD_HEADER else (0, 0, 0, 0)
            if len(head) == RECORD_HEADER and cap > _frame_limit(snaplen):
                raise ValueError(f"broken record at octet {at} of {partition.capture}")
            frame = f.read(cap) if len(head) == RECORD_HEADER else b""
            broken = len(head) < RECORD_HEADER or len(frame) < cap
            yield (
                partition.capture, partition.label, partition.super_label, partition.base + partition.start,
                partition.base + at, ordinal, partition.base + partition.size, seconds * 1_000_000_000 + fraction * unit, cap, wire, None if broken else frame, broken, link,
            )
            if broken:
                break
            at += RECORD_HEADER + cap
            ordinal += 1

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


class WrittenParts(WriterCommitMessage):
    """A task's list of captures by its name, how long it is, and a capture that was there before."""

    def __init__(self, token: str, n: int, taken: str | None):
        self.token, self.n, self.taken = token, n, taken


class CaptureWriter(DataSourceArrowWriter):
    """One file per value of ``capture`` in a task, in a folder of the task until the job commits.

    The commit is the rename of one manifest. Overwriting replaces the captures of earlier jobs, whose
    files are deleted when the new ones are in place; files that no job has written stay. Files of
    failed attempts carry the job's name and go with the commit or the abort. ``write_captures`` names
    the job and gives parts their names in tasks; else the driver does so.
    """

    def __init__(self, root: str, overwrite: bool, job: str | None = None):
        self.root, self.overwrite, self.job, self.named = root, overwrite, job or uuid.uuid4().hex, job is not None

    def write(self, batches: Iterator[pa.RecordBatch]) -> WrittenParts:
        store, root = _filesystem(self.root)
        token = uuid.uuid4().hex
        folder = f"{root}/.{self.job}-{token}"
        store.create_dir(folder, recursive=True)
        names: dict[str, None] = {}
        there: dict[str, bool] = {}
        taken = out = current = None
        chunks, size = [], 0
        try:
            for batch in batches:
                columns = [batch.column(name).to_pylist() for name in ("capture", "ts_us", "wire_len", "frame")]
                for capture, ts_us, wire_len, frame in zip(*columns):
                    if capture != current or out is None:
                        if out:
                            out.write(b"".join(chunks))
                            out.close()
                        if capture is None:
                            raise ValueError("a capture needs a name")
                        if capture in names:
                            raise ValueError("rows of a capture must be next to each other")
                        out = store.open_output_stream(f"{folder}/.{len(names)}.part")
                        current, names[capture] = capture, None
                        chunks, size = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, MAX_FRAME_OCTETS, ETHERNET)], 0
                        if not (self.overwrite or taken) and self._taken(store, f"{root}/{capture}", there):
                            taken = f"{root}/{capture}"
                    seconds, micros = divmod(ts_us, 1_000_000)
                    chunks += struct.pack("<IIII", seconds, micros, len(frame), max(wire_len or 0, len(frame))), frame
                    size += RECORD_HEADER + len(frame)
                    if size >= READ_OCTETS:
                        out.write(b"".join(chunks))
                        chunks, size = [], 0
            if out:
                out.write(b"".join(chunks))
        finally:
            if out:
                out.close()
        lists = f"{root}/.captures-{self.job}"
        store.create_dir(lists)
        with io.BufferedWriter(store.open_output_stream(f"{lists}/.{token}.json"), READ_OCTETS) as f:
            f.writelines(json.dumps(name).encode() + b"\n" for name in names)
        return WrittenParts(token, len(names), taken)

    @staticmethod
    def _taken(store: arrow_fs.FileSystem, path: str, there: dict[str, bool]) -> bool:
        """Whether a capture has been there before; ``there`` keeps which folders have."""
        found = lambda name: store.get_file_info(name).type != arrow_fs.FileType.NotFound
        if (folder := os.path.dirname(path)) not in there:
            there[folder] = found(folder)
        return there[folder] and found(path)

    def commit(self, messages) -> None:
        store, root = _filesystem(self.root)
        done = [m for m in messages if m and m.n]
        if taken := [m.taken for m in done if m.taken]:
            self.abort(messages)
            raise FileExistsError(taken[0])
        Manifests(store, root).commit(self.job, self.overwrite, [], [(m.token, m.n) for m in done])
        # whoever reads now finds the parts by the manifest, so that the renames need not be one step
        if not self.named:
            manifests = Manifests(store, root)
            for since in _ranges(manifests, self.job):
                manifests.name_parts(*since)
            manifests.delete(list(manifests.gone("")))
            manifests.drop_void()
            self.sweep()

    def abort(self, messages) -> None:
        """Remove the job's files, of failed attempts too."""
        store, root = _filesystem(self.root)
        self.sweep()
        if store.get_file_info(f"{root}/.captures-{self.job}").type != arrow_fs.FileType.NotFound:
            store.delete_dir(f"{root}/.captures-{self.job}")

    def sweep(self) -> None:
        """Remove the job's folders of parts, and with them what failed attempts have left."""
        store, root = _filesystem(self.root)
        for info in store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f".{self.job}-"):
                store.delete_dir(info.path)


def _ranges(manifests: Manifests, job: str) -> list[tuple[dict, str, int, int]]:
    """Parts of the lists of a job, each the work of a task."""
    return [
        (m, token, since, min(since + RENAMES, n)) for m in manifests.live if m["job"] == job
        for token, n in m["lists"] for since in range(0, n, RENAMES)]


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return COUNT_SCHEMA if self.options.get("counts") == "true" else RAW_SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(
            self.options["path"], int(self.options.get("levels", "1")),
            int(self.options.get("splitOctets", DEFAULT_SPLIT_OCTETS)), self.options.get("counts") == "true",
            several=self.options.get("several") == "true", lists=self.options.get("lists"),
        )

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], overwrite, self.options.get("job"))


def _read_json(folder: str, name: str) -> list:
    store, path = _filesystem(folder)
    with store.open_input_stream(f"{path}/{name}.json") as f:
        return json.loads(f.read())


def _write_json(folder: str, name: str, content: list) -> None:
    store, path = _filesystem(folder)
    with store.open_output_stream(f"{path}/{name}.json") as f:
        f.write(json.dumps(content).encode())


def _in_tasks(spark: SparkSession, items: list, work: Callable[..., Iterable[tuple]], schema: str, fields: pa.Schema) -> DataFrame:
    """Rows of ``work`` for each of ``items``, each in a task of its own as far as there are not too many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = iter(work(*items[k]))
                while some := list(islice(rows, ROWS_PER_BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some), fields)], schema=fields)

    return spark.range(0, len(items), 1, max(1, min(len(items), LISTING_TASKS))).mapInArrow(run, schema)


INDEX_SCHEMA = pa.schema([("name", pa.string()), ("label", pa.string()), ("cost", pa.int64()), ("several", pa.bool_())])


def list_splits(spark: SparkSession, root: str, levels: int, split_octets: int) -> str | None:
    """Folder with lists of splits, an index of them, and None where Arrow cannot open the shared folder.

    Each folder of captures is listed by one task. Captures of one split and others have lists of their own.
    """
    path = staged_path(spark, "splits")
    lists = path.removeprefix("file:") if path.startswith("file:") else re.sub("^s3[an]://", "s3://", path)
    try:
        store, folder = _filesystem(lists)
        store.create_dir(folder, recursive=True)
    except (pa.ArrowException, ValueError, OSError):
        return None
    files, top = _filesystem(root)
    manifests = Manifests(files, top)

    def work(within: str) -> Iterator[tuple]:
        pending: dict[bool, list[FileSplit]] = {False: [], True: []}
        costs = {False: 0, True: 0}

        def listed(several: bool) -> tuple:
            splits, cost, name = pending[several], costs[several], uuid.uuid4().hex
            _write_json(lists, name, [
                [s.path, s.capture, s.label, s.super_label, s.start, s.end, s.size, s.base] for s in splits])
            pending[several], costs[several] = [], 0
            return name, splits[0].label, cost, several

        for found in _captures_in(files, top, within, levels, split_octets, manifests):
            several = len(found) > 1
            for split in found:
                cost = _cost(split, split_octets)
                if pending[several] and costs[several] + cost > split_octets:
                    yield listed(several)
                pending[several].append(split)
                costs[several] += cost
        yield from (listed(several) for several in (False, True) if pending[several])

    folders = [(f,) for f in _folders(files, top, levels, manifests)]
    index = _in_tasks(spark, folders, work, "name STRING, label STRING, cost BIGINT, several BOOLEAN", INDEX_SCHEMA)
    _write_json(lists, "index", [list(r) for r in index.collect()])
    return lists


def settle(spark: SparkSession, root: str, job: str) -> None:
    """Give the parts of a committed job their names, in tasks, and delete what it has replaced."""
    store, path = _filesystem(root)
    manifests = Manifests(store, path)

    def name_parts(*given) -> list[tuple]:
        manifests.name_parts(*given)
        return []

    one, fields = "capture STRING, live BOOLEAN", pa.schema([("capture", pa.string()), ("live", pa.bool_())])
    _in_tasks(spark, _ranges(manifests, job), name_parts, one, fields).count()
    if manifests.void:
        listed = [(m, t, live) for ms, live in ((manifests.void, False), (manifests.live, True)) for m in ms for t in manifests.lists(m)]
        found = _in_tasks(spark, listed, lambda m, t, live: ((c, live) for _, c in manifests.entries(m, t)), one, fields)

        def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                manifests.delete(batch.column(0).to_pylist())
                yield batch.slice(0, 0)

        found.groupBy("capture").agg(F.max("live").alias("live")).filter("NOT live").mapInArrow(delete, one).count()
        manifests.drop_void()
    CaptureWriter(root, True, job).sweep()


def scan_captures(
    spark: SparkSession, root: str, levels: int = 1, split_octets: int = DEFAULT_SPLIT_OCTETS, counts: bool = False,
    several: bool = False, lists: str | None = None,
) -> DataFrame:
    """Records as found in the files, truncated last records included; or ``counts`` of each split.

    ``several`` leaves out captures that are one split. ``lists`` is of ``list_splits``, made here if not given.
    """
    spark.dataSource.register(CaptureSource)
    reader = spark.read.format("capture").option("levels", levels).option("splitOctets", split_octets)
    reader = reader.option("counts", str(counts).lower()).option("several", str(several).lower())
    lists = lists or list_splits(spark, root, levels, split_octets)
    return (reader.option("lists", lists) if lists else reader).load(root)


def read_captures(
    spark: SparkSession, root: str, levels: int = 1, split_octets: int = DEFAULT_SPLIT_OCTETS
) -> DataFrame:
    """One row per frame under ``root/<label>/``, or ``root/<super label>/<label>/`` with two levels.

    Frame numbers are 1-based per capture. A first pass counts the frames of each file split and
    checks that splits join up; the second adds the counts of the splits before to the place inside
    the split. No frame is moved or sorted for it, and the first pass hands on no frames at all. A
    capture that is one split is read from its first octet to its last and needs no first pass.
    ``link_type`` is that of the file; ``decode_headers`` finds the network header by it.
    """
    lists = list_splits(spark, root, levels, split_octets)
    numbered = scan_captures(spark, root, levels, split_octets, lists=lists).filter(~F.col("truncated"))
    earlier = F.lit(0).cast("bigint")
    if lists is None or any(several for *_, several in _read_json(lists, "index")):
        before = split_counts(scan_captures(spark, root, levels, split_octets, counts=True, several=True, lists=lists))
        few = before.count() <= SHARED_SPLITS
        numbered = numbered.join(F.broadcast(before) if few else before, ["capture", "start"], "left")
        earlier = F.coalesce("_before", earlier)
    return numbered.select(
        "capture", "label", "super_label",
        (earlier + F.col("ordinal") + 1).alias("frame_no"),
        quotient(F.col("ts_ns"), 1000).alias("ts_us"),
        (F.col("ts_ns").cast("decimal(20,0)") / F.lit(1_000_000_000)).cast("decimal(20,9)").alias("ts_epoch"),
        "cap_len", "wire_len", "frame", "link_type",
    )


def split_counts(counts: DataFrame) -> DataFrame:
    """(capture, start, _before): frames of the capture before each split, from ``COUNT_SCHEMA`` rows.

    An error where the records of splits do not join up, or do not reach the end of their file.
    """
    splits = counts.select(
        "capture", "start", F.col("n").alias("_n"), F.col("first").alias("_first"), F.col("behind").alias("_end"),
        F.col("file_end").alias("_file_end"))
    order = W.partitionBy("capture").orderBy("start")
    carried = splits.select(
        "capture", "start", "_first", "_end", "_file_end", F.lag("_end").over(order).alias("_expected"),
        F.lead("_first").over(order).alias("_following"),
        F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # the first record of a file stands behind its header
    joined = (F.col("_first") % PART_OCTETS == FILE_HEADER) | F.coalesce(F.col("_first") == F.col("_expected"), F.lit(False))
    joined = joined & ((F.col("_end") == F.col("_file_end")) | F.coalesce(F.col("_end") == F.col("_following"), F.lit(False)))
    apart = F.raise_error(F.concat(F.lit("file splits do not join up in "), F.col("capture"))).cast("boolean")
    checked = carried.filter(F.when(joined, True).otherwise(apart))
    return stage(checked.select("capture", "start", "_before"))


def truncated_records(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """Captures whose last record is cut off."""
    return scan_captures(spark, root, levels).filter("truncated").groupBy("capture").agg(
        F.count(F.lit(1)).alias("n_truncated"))


def list_captures(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """(capture, label) of every file, frames or not."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split("path", "/")
    # a part stands one level deeper, in the folder of its capture
    depth = F.when(F.element_at(parts, -1).rlike(f"^{PART_NAME.pattern}$"), 1).otherwise(0)
    names = F.slice(parts, -(levels + 1) - depth, F.lit(levels + 1))
    return found.select(F.array_join(names, "/").alias("capture"), F.element_at(names, -2).alias("label")).distinct()


def write_captures(
    df: DataFrame, root: str, mode: str = "append", frames_per_part: int | None = None
) -> None:
    """Write ``capture, frame_no, ts_us, frame[, wire_len]`` rows as capture files in frame order.

    A capture is one file, or with ``frames_per_part`` a folder of its name with parts of so many
    frames, written by different tasks. ``read_captures`` gives the same captures and numbers back
    in both forms.
    """
    df.sparkSession.dataSource.register(CaptureSource)
    wire = F.col("wire_len") if "wire_len" in df.columns else F.length("frame")
    name = F.col("capture")
    if frames_per_part:
        part = quotient(F.col("frame_no") - 1, frames_per_part)
        name = F.concat("capture", F.lit("/part-"), F.lpad(part.cast("string"), 7, "0"), F.lit(".pcap"))
    rows = df.select(name.alias("capture"), "frame_no", "ts_us", wire.cast("int").alias("wire_len"), "frame")
    placed = rows.repartition("capture").sortWithinPartitions("capture", "frame_no")
    job = uuid.uuid4().hex
    placed.write.format("capture").option("job", job).mode(mode).save(root)
    settle(df.sparkSession, root, job)
