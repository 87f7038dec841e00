"""JSON array files read by byte ranges: one file gives many tasks.

A range starts anywhere, also inside a string. Every range is first summed up for each state
that it may start in (outside strings, inside one, behind a backslash): the state it ends
in and the change of depth. Composing these few numbers gives every range its true state. A
second pass over ranges of known state finds the array and counts its elements, so that places
in the file are known, and the third reads: each range gives the elements that begin in it
and reads on to the end of its last one.

Ranges come to Spark as partitions of a Python data source; only sums a range reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as Ty
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of a range that grows with its files, of a look back for a key, and of a step past a range's end.
RANGE_BYTES = 64 << 20
GROWN_BYTES = 8 << 20
LOOK_BACK = 64
READ_ON = 1 << 16
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
FORMAT = "quire_json_ranges"


def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _bytes(path: str, start: int, end: int) -> bytes:
    with _opened(path) as f:
        f.seek(start)
        return f.read(end - start)


@dataclass(frozen=True)
class Marks:
    """Structural characters of a range: places of brackets, commas and colons outside strings, the depth behind each, and the state at the end."""

    at: np.ndarray
    what: np.ndarray
    depth: np.ndarray
    state: int


def marks(data: bytes, state: int, depth: int = 0) -> Marks:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return Marks(*(np.zeros(0, np.int64),) * 3, state)
    plain = np.maximum.accumulate(np.where(b != 92, np.arange(len(b)), -1))  # last byte that is no backslash
    carried = 1 if state == ESCAPED else 0

    def escaped(places: np.ndarray) -> np.ndarray:
        """An odd run of backslashes stands before."""
        before = np.where(places > 0, plain[places - 1], -1)
        run = places - 1 - before + np.where(before < 0, carried, 0)
        return run % 2 == 1

    quotes = np.flatnonzero(b == 34)
    quotes = quotes[~escaped(quotes)]
    inside = state != OUTSIDE
    structural = np.flatnonzero(np.isin(b, np.frombuffer(b"[]{},:", np.uint8)))
    structural = structural[(np.searchsorted(quotes, structural) + inside) % 2 == 0]
    what = b[structural]
    change = np.isin(what, (91, 123)).astype(np.int64) - np.isin(what, (93, 125))
    end_inside = (len(quotes) + inside) % 2 == 1
    end = OUTSIDE if not end_inside else ESCAPED if escaped(np.array([len(b)]))[0] else INSIDE
    return Marks(structural.astype(np.int64), what, depth + np.cumsum(change), int(end))


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file; state and depth at the start once known; the array's first and last byte, its depth and the place of the range's first element."""

    path: str
    start: int
    end: int
    size: int
    state: int = 0
    depth: int = 0
    first: int = 0
    last: int = 0
    level: int = 0
    ord: int = 0


def _sums(r: Range) -> Iterator[tuple]:
    """(start state, end state, change of depth) for each state."""
    data = _bytes(r.path, r.start, r.end)
    for state in (OUTSIDE, INSIDE, ESCAPED):
        found = marks(data, state)
        yield r.path, r.start, json.dumps([state, found.state, int(found.depth[-1]) if len(found.depth) else 0])


def _events(r: Range) -> Iterator[tuple]:
    """What concerns the document's outermost arrays: keys and brackets down to depth 2, with the commas between them."""
    data = _bytes(r.path, r.start, r.end)
    found = marks(data, r.state, r.depth)
    before = np.r_[r.depth, found.depth[:-1]] if len(found.depth) else found.depth
    opens = np.isin(found.what, (91, 123)) & (found.depth <= 2)
    closes = np.isin(found.what, (93, 125)) & (before <= 2)
    keys = (found.what == 58) & (found.depth == 1)
    events = np.flatnonzero(opens | closes | keys)
    commas = {level: np.flatnonzero((found.what == 44) & (found.depth == level)) for level in (1, 2)}
    edges = np.r_[-1, events, len(found.at)]
    rows = []
    for i in range(len(edges) - 1):
        between = [int(np.searchsorted(commas[level], edges[i + 1]) - np.searchsorted(commas[level], edges[i], "right")) for level in (1, 2)]
        e = edges[i]
        if e < 0:
            rows.append([r.start, "", 0, between])
            continue
        place, name = r.start + int(found.at[e]), chr(found.what[e])
        if name == ":":
            low = max(0, place - LOOK_BACK)
            text = _bytes(r.path, low, place).rstrip()
            name = ":" + next((k for k in _WRAPPERS if text.endswith(f'"{k}"'.encode()) and not text.endswith(f'\\"{k}"'.encode())), "")
        rows.append([place, name, int(found.depth[e]), between])
    yield r.path, r.start, json.dumps(rows)


def _elements(r: Range) -> Iterator[tuple]:
    """(path, place, element) of the elements that begin in the range."""
    data = _bytes(r.path, r.start, r.end)
    found = marks(data, r.state, r.depth)

    def borders(m: Marks, base: int) -> np.ndarray:
        """Places of the array's opening bracket, commas and closing bracket."""
        at = m.at + base
        comma = (m.what == 44) & (m.depth == r.level) & (at > r.first) & (at < r.last)
        return at[comma | (at == r.first) | (at == r.last)]

    own = borders(found, r.start)
    starts = own[own < r.last]
    if not len(starts):
        return
    at, state, depth, ends = r.end, found.state, int(found.depth[-1]) if len(found.depth) else r.depth, list(own)
    while ends[-1] == starts[-1]:  # the last element ends in a later range
        more = _bytes(r.path, at, min(r.size, at + READ_ON))
        if not more:
            break
        data += more
        found = marks(more, state, depth)
        ends += list(borders(found, at)[:1])
        at, state, depth = at + len(more), found.state, int(found.depth[-1]) if len(found.depth) else depth
    place = r.ord
    for a, b in zip(ends, ends[1:]):
        raw = data[a + 1 - r.start : b - r.start].strip()
        if raw:
            yield r.path, place, raw.decode("utf-8", "replace")
        place += 1


_WRAPPERS = ("chunks", "nodes", "items")
_STEPS = {"sums": _sums, "events": _events, "elements": _elements}


class RangeSource(DataSource):
    """Options: ``step`` and ``ranges`` (JSON list of the ranges' fields)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, at long, value string"

    def reader(self, schema: Ty.StructType) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.step, self.ranges = options["step"], json.loads(options["ranges"])

    def partitions(self) -> list[InputPartition]:
        ranges, self.ranges = self.ranges, []  # the reader goes to every task: it takes its own range only
        return [Range(*fields) for fields in ranges]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from _STEPS[self.step](partition)


def _step(spark: SparkSession, step: str, ranges: list[Range]) -> DataFrame:
    if not ranges:
        return spark.createDataFrame([], "file string, at long, value string")
    spark.dataSource.register(RangeSource)
    fields = [[r.path, r.start, r.end, r.size, r.state, r.depth, r.first, r.last, r.level, r.ord] for r in ranges]
    return spark.read.format(FORMAT).option("step", step).option("ranges", json.dumps(fields)).load()


def _range_bytes(total: int, least: int, tasks: int) -> int:
    """At least ``least``, and up to ``GROWN_BYTES`` where files are so large that each of ``tasks`` still has a range to read."""
    return max(least, min(GROWN_BYTES, total // max(tasks, 1)))


def byte_ranges(files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> list[Range]:
    return [Range(path, a, min(a + range_bytes, size), size) for path, size in files for a in range(0, size, range_bytes)]


def _with_states(ranges: list[Range], sums: dict) -> tuple[list[Range], set[str]]:
    """Start states by composition, and the files that do not end outside strings at depth 0."""
    state, depth, broken = OUTSIDE, 0, set()
    for i, r in enumerate(ranges):
        if r.start == 0:
            state, depth = OUTSIDE, 0
        r.state, r.depth = state, depth
        end, change = sums[r.path, r.start][state]
        state, depth = end, depth + change
        if r.end == r.size and (state != OUTSIDE or depth):
            broken.add(r.path)
    return ranges, broken


@dataclass
class _Array:
    first: int
    level: int
    name: str
    last: int = -1
    commas: int = 0
    starts: dict | None = None


def _located(ranges: list[Range], events: dict) -> list[Range]:
    """Ranges of each file's array of elements, with the place of their first element: the document itself, else the first wrapper key whose array has any."""
    out = []
    files: dict[str, list[Range]] = {}
    for r in ranges:
        files.setdefault(r.path, []).append(r)
    for own in files.values():
        arrays, open_at, key = [], {}, ""
        for r in own:
            for a in open_at.values():
                a.starts[r.start] = a.commas + 1  # elements that began in earlier ranges
            for place, name, depth, commas in events[r.path, r.start]:
                if name.startswith(":"):
                    key = name[1:]
                elif name == "[" and (depth == 1 or (depth == 2 and key)):
                    open_at[depth] = _Array(place, depth, key if depth == 2 else "", starts={r.start: 0})
                elif name in ("]", "}") and depth + 1 in open_at:
                    a = open_at.pop(depth + 1)
                    a.last = place
                    arrays.append(a)
                if name in ("]", "}", "[", "{") and depth == 1:
                    key = ""
                for level, a in open_at.items():
                    a.commas += commas[level - 1]
        document = [a for a in arrays if a.level == 1]
        wrapped = [a for k in _WRAPPERS for a in arrays if a.level == 2 and a.name == k and a.last - a.first > 1]
        chosen = document[0] if document else wrapped[0] if wrapped else None
        if chosen:
            for r in own:
                if r.start <= chosen.last and r.end > chosen.first and r.start in chosen.starts:
                    r.first, r.last, r.level, r.ord = chosen.first, chosen.last, chosen.level, chosen.starts[r.start]
                    out.append(r)
    return out


def scan_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, ord, raw) of the elements of JSON array files, or of the array under a wrapper key; ``ord`` counts from 0 in the file.

    Files are listed by Spark and read by range through pyarrow's file systems (local, HDFS, object
    stores). A file that ends inside a string or brackets gives no rows; an element that is
    no JSON does not spoil the others. Blank elements are left out. ``range_bytes`` is the least size of a range:
    large inputs are read in larger ones, a few for every core.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect()  # names and sizes, no content
    size = _range_bytes(sum(r.length for r in listed), range_bytes, 4 * spark.sparkContext.defaultParallelism)
    ranges = byte_ranges(sorted((r.path if "://" in r.path else r.path.replace("file:", "file://"), r.length) for r in listed), size)
    sums: dict = {}
    for row in _step(spark, "sums", ranges).collect():  # three small rows a range, all ranges in one job
        state, end, change = json.loads(row.value)
        sums.setdefault((row.file, row.at), {})[state] = (end, change)
    ranges, broken = _with_states(ranges, sums)
    events = {(row.file, row.at): json.loads(row.value) for row in _step(spark, "events", [r for r in ranges if r.path not in broken]).collect()}
    held = _located([r for r in ranges if r.path not in broken], events)
    return _step(spark, "elements", held).selectExpr("file", "at AS ord", "value AS raw")
