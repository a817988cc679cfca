"""The field's files as a data source: spark.read.format("families").option("kind", "msa").load(folder), and back.

    register(spark)
    spark.read.format("families").option("kind", "msa").option("families", '["a"]').load(folder)   # opens one file

Rows are those of the readers of formats.py, a file a family, `per_partition` files (64 by default) a partition.  Families
are chosen by an option, before any file is opened, and not by the conditions of a query: Spark 4.1 remembers those that
it has handed to a source in Python, so that a frame used twice would get the wrong files.  A file that breaks its format is
an error that names the family.

Writing puts `<folder>/<family>.txt` in place once all tasks have ended, and nothing if one failed.  A family's rows must
come one after the other, in their order, in one partition (`repartition("family").sortWithinPartitions("family", ...)`):
a task holds a family at a time, and a family from two places is an error.  Mode overwrite replaces a folder's files, append adds
families, of which none may exist.

Folders are reached by pyarrow's file systems (local or mounted folders, and stores that it knows by their scheme), from
Python without Spark's own file access; what only Spark can read is read by the functions of formats.py.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _counted(lines: list[str], what: str) -> int:
    n, _, rest = lines[0].partition(" ") if lines else ("", "", "")
    if not n.isdigit() or rest.split()[:1] != [what]:
        raise ValueError(f"no number of {what} at its head")
    return int(n)


def _numbers(cast: Callable) -> Callable[[list[str]], Iterator[tuple]]:
    def rows(lines: list[str]) -> Iterator[tuple]:
        values = lines[1].split() if len(lines) > 1 else []
        if len(values) != _counted(lines, "sites"):
            raise ValueError("wrong number of sites")
        return ((k, cast(v)) for k, v in enumerate(values))

    return rows


def _records(lines: list[str]) -> Iterator[tuple]:
    if len(lines) % 2 or not all(x.startswith(">") for x in lines[::2]):
        raise ValueError("not two-line FASTA")
    return ((name[1:], seq) for name, seq in zip(lines[::2], lines[1::2], strict=True))


def _branches(lines: list[str]) -> Iterator[tuple]:
    n = _counted(lines, "nodes")
    names, edges = set(lines[1 : n + 1]), [x.split() for x in lines[n + 2 :]]
    if len(edges) != _counted(lines[n + 1 :], "edges"):
        raise ValueError("wrong number of edges")
    order: dict[str, int] = {}
    for parent, child, length in edges:
        if parent not in names or child not in names:
            raise ValueError("an edge between unknown nodes")
        yield parent, child, order.setdefault(parent, 0), float(length)
        order[parent] += 1


def _square(lines: list[str]) -> Iterator[tuple]:
    n, rows = _counted(lines, "sites"), lines[1:]
    if len(rows) != n or any(len(r) != n or set(r) - set("01") for r in rows):
        raise ValueError("not a square contact map")
    return ((i, j) for i, r in enumerate(rows) for j, c in enumerate(r) if c == "1")


def _moves(lines: list[str]) -> Iterator[tuple]:
    if len(lines) - 1 != _counted(lines, "transitions"):
        raise ValueError("wrong number of transitions")
    for k, line in enumerate(lines[1:]):
        x, y, t = line.split(" ")
        yield k, x, y, float(t)


def _branch_lines(rows: list[Row]) -> list[str]:
    names = sorted({str(r[c]) for r in rows for c in ("parent", "child")})
    return [f"{len(names)} nodes", *names, f"{len(rows)} edges", *(f"{r['parent']} {r['child']} {r['length']}" for r in rows)]


@dataclass(frozen=True)
class Kind:
    """A format: columns after the family, rows of a file's lines, and lines of a family's rows (None: only read)."""

    columns: str
    rows: Callable[[list[str]], Iterable[tuple]]
    lines: Callable[[list[Row]], list[str]] | None


KINDS = {
    "msa": Kind("seq_name string, seq string", _records, lambda rows: [x for r in rows for x in (f">{r['seq_name']}", str(r["seq"]))]),
    "tree": Kind("parent string, child string, child_ord int, length double", _branches, _branch_lines),
    "site_rates": Kind("site int, rate double", _numbers(float), lambda rows: [f"{len(rows)} sites", " ".join(str(r["rate"]) for r in rows)]),
    "sites_subset": Kind("k int, site int", _numbers(int), lambda rows: [f"{len(rows)} sites", " ".join(str(r["site"]) for r in rows)]),
    "contact_map": Kind("i int, j int", _square, None),
    "transitions": Kind("tid int, x string, y string, t double", _moves, lambda rows: [f"{len(rows)} transitions", *(f"{r['x']} {r['y']} {r['t']}" for r in rows)]),
}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Files(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(0)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.kind, self.per = options["path"], KINDS[options["kind"]], int(options.get("per_partition", 64))
        self.families: set[str] | None = set(json.loads(options["families"])) if "families" in options else None

    def partitions(self) -> list[_Files]:
        store, folder = _store(self.folder)
        found = sorted(x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.is_file and not x.base_name.startswith((".", "_")))
        paths = [p for p in found if self.families is None or _family(p) in self.families]
        return [_Files(paths[k : k + self.per]) for k in range(0, len(paths), self.per)]

    def read(self, partition: _Files | None) -> Iterator[tuple]:
        store = _store(self.folder)[0]
        for path in partition.paths if partition else []:  # Spark reads once where there is no partition
            with store.open_input_stream(path) as stream:
                text = stream.read().decode().replace("\r\n", "\n").rstrip("\n")
            try:
                for row in self.kind.rows(text.split("\n") if text else []):
                    yield (_family(path), *row)
            except ValueError as wrong:
                raise ValueError(f"{wrong}: {_family(path)}") from wrong


def _family(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


@dataclass
class _Written(WriterCommitMessage):
    families: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite, self.lines = options["path"], overwrite, KINDS[options["kind"]].lines
        if self.lines is None:
            raise ValueError(f"kind {options['kind']} is only read")
        self.aside = posixpath.join(_store(self.folder)[1], f"_{uuid.uuid4().hex}")

    def write(self, rows: Iterator[Row]) -> _Written:
        store, _ = _store(self.folder)
        store.create_dir(self.aside)
        done: list[str] = []
        for family, own in groupby(rows, lambda r: r["family"]):
            if family in done:
                raise ValueError(f"a family's rows are not together: {family}")
            done.append(family)
            with store.open_output_stream(posixpath.join(self.aside, f"{uuid.uuid4().hex}-{family}.txt")) as stream:
                stream.write("".join(f"{x}\n" for x in self.lines(list(own))).encode())
        return _Written(done)

    def _put(self, store: fs.FileSystem) -> list[tuple[str, str]]:
        """Files written aside, and their families."""
        found = store.get_file_info(fs.FileSelector(self.aside, allow_not_found=True))
        return [(x.path, x.base_name[33:-4]) for x in found]

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.folder)
        families = [f for m in messages if m for f in m.families]
        if len(families) != len(set(families)):
            self.abort(messages)
            raise ValueError("rows of a family came from several partitions")
        there = {_family(x.path): x.path for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.is_file}
        if not self.overwrite and set(families) & set(there):
            self.abort(messages)
            raise ValueError(f"families exist already: {sorted(set(families) & set(there))[:3]}")
        if self.overwrite:
            for path in there.values():
                store.delete_file(path)
        placed: set[str] = set()
        for path, family in self._put(store):  # a task that was run again has left its files twice, which are alike
            if family in families and family not in placed:
                store.move(path, posixpath.join(folder, f"{family}.txt"))
                placed.add(family)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _store(self.folder)
        if store.get_file_info(self.aside).type == fs.FileType.Directory:
            store.delete_dir(self.aside)


class Families(DataSource):
    """Options: kind, a name of KINDS; path, the folder; families, a JSON list; per_partition, files of a partition."""

    @classmethod
    def name(cls) -> str:
        return "families"

    def _options(self) -> dict[str, str]:
        options = dict(self.options)
        if options.get("kind") not in KINDS:
            raise ValueError(f"no kind {options.get('kind')}; there are {sorted(KINDS)}")
        return options

    def schema(self) -> str:
        return f"family string, {KINDS[self._options()['kind']].columns}"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self._options(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(Families)
