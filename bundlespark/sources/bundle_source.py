"""The "bundle" data source: directory trees of Markdown files, listed, read and written by tasks.

Reading. The planner lists a bounded number of directories, breadth first, and makes
partitions of the files right in them and of the subtrees that it did not enter; tasks
list those themselves, so no list of paths exists anywhere. A partition may be one
of several slices, which hash the paths among them: that splits a directory of very many
files. What a task works out of a file follows from the columns of the schema that is
asked for: bodies are parsed as Markdown only for columns that Markdown gives, YAML is
read only for frontmatter or errors, and files aren't opened for their paths alone.

    spark.dataSource.register(BundleSource)
    spark.read.format("bundle").schema("source_path string, json string").load(root)

Writing. A task writes its files below a folder of its own in ``STAGING``. Only the commit
of the whole write, which knows the attempts that count, records them and moves their
files into place, so a failed, retried or speculative task never touches the bundle. A
recorded commit that was cut off is finished by ``recover``, which every write begins
with. Other files of the bundle stay as they are.

Driver and tasks must see the bundle at the same path.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, StringStartsWith, WriterCommitMessage

from . import markdown, yamlio

RESERVED = ("index.md", "log.md")
#: Where writes are prepared, below the bundle's root; readers pass over it.
STAGING = ".bundle-staging"
#: Directories that the planner lists at most; files of one directory that a task takes, about; slices of a subtree that it didn't list.
LISTED, FILES_A_TASK, SLICES = 64, 2_000, 4
#: Files in a batch.
BATCH = 512
#: Threads that move files at commit.
MOVERS = 16

CONCEPTS = "source_path string, json string, body string, modified double, error string, " + markdown.FACTS
FILES, LOGS = "path string", "path string, text string"
_FACTS = {c.split()[0] for c in markdown.FACTS.split(", ")}


@dataclass
class Files(InputPartition):
    """Files below the directories ``at``, or right in them if ``flat``, whose paths hash to ``slice`` of ``slices``."""

    at: tuple[str, ...]
    flat: bool
    slice: int = 0
    slices: int = 1


def _wanted(path: str, what: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    if what == "logs":
        return name == "log.md"
    return what != "concepts" or name.endswith(".md") and name not in RESERVED


def _fail(e: OSError):
    raise e


def _walk(root: str, at: str, flat: bool, dirs_only: bool = False) -> Iterator[str]:
    """Relative paths with '/' of the regular files, or of the directories, below ``at``."""
    for here, dirs, files in os.walk(os.path.join(root, at), onerror=_fail):
        base = os.path.relpath(here, root).replace(os.sep, "/")
        prefix = "" if base == "." else base + "/"
        dirs[:] = [] if flat and not dirs_only else sorted(d for d in dirs if prefix + d != STAGING)
        if dirs_only:
            yield from (prefix + d for d in dirs)
            if flat:
                dirs[:] = []
        else:
            yield from (prefix + f for f in files if os.path.isfile(os.path.join(here, f)))


class BundleReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.root, self.what, self.schema = options["path"], options.get("what", "concepts"), schema
        self.listed = int(options.get("listed", LISTED))
        self.under: list[str] = []

    def _possible(self, at: str) -> bool:
        below = at + "/" if at else ""
        return all(below.startswith(u) or u.startswith(below) for u in self.under)

    def partitions(self) -> list[Files]:
        todo, found, few, held = [""], [], [], 0
        for n in range(self.listed):
            if n >= len(todo):
                break
            at, files = todo[n], 0
            try:
                with os.scandir(os.path.join(self.root, at)) as entries:
                    for e in entries:
                        path = f"{at}/{e.name}" if at else e.name
                        if not e.is_dir(follow_symlinks=False):
                            files += 1
                        elif path != STAGING and self._possible(path):
                            todo.append(path)
            except (FileNotFoundError, NotADirectoryError):
                if at:
                    raise
            slices = -(-files // FILES_A_TASK)
            if slices > 1 or self.what == "dirs":
                found += [Files((at,), True, s, max(1, slices)) for s in range(max(1, slices))]
            elif files:
                few, held = [*few, at], held + files
                if held >= FILES_A_TASK:
                    found, few, held = [*found, Files(tuple(few), True)], [], 0
        found += [Files(tuple(few), True)] if few or not found else []
        return found + [Files((at,), False, s, SLICES) for at in todo[self.listed:] for s in range(SLICES)]

    def read(self, partition: Files):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.schema), []
        for path in (p for at in partition.at for p in _walk(self.root, at, partition.flat, self.what == "dirs")):
            if not _wanted(path, self.what) or partition.slices > 1 and zlib.crc32(path.encode("utf-8", "surrogateescape")) % partition.slices != partition.slice:
                continue
            rows.append(self._row(path, set(schema.names)))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _row(self, path: str, names: set) -> dict:
        row, full = {"path": path, "source_path": path}, os.path.join(self.root, path)
        if "modified" in names:
            row["modified"] = os.path.getmtime(full)
        if "text" in names:
            with open(full, encoding="utf-8") as f:
                row["text"] = f.read()
        if names & {"json", "body", "error", *_FACTS}:
            body = None
            try:
                with open(full, encoding="utf-8", newline="") as f:
                    whole = f.read()
                fm, body = yamlio.parse(whole)
                if "json" in names:
                    row["json"] = yamlio.to_json(fm)
            except (yamlio.DocumentError, UnicodeDecodeError) as e:
                row["error"] = str(e)
            row["body"] = body
            if names & _FACTS:
                row |= markdown.facts(body)
        return {k: v for k, v in row.items() if k in names}


class PruningReader(BundleReader):
    """A reader that also takes filters on the path; Spark wants spark.sql.python.filterPushdown.enabled for it."""

    def pushFilters(self, filters):
        """Paths that a subtree or partition can't have are never listed; Spark checks each row all the same."""
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith)) and f.attribute in (("source_path",), ("path",)) and isinstance(f.value, str):
                self.under.append(f.value)
        return filters


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class BundleWriter(DataSourceArrowWriter):
    """Files from rows with source_path and text. Of rows with one path one stays, whichever; null texts are empty."""

    given = "text"

    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex
        recover(root)

    def write(self, iterator) -> Attempt:
        folder = uuid.uuid4().hex
        top = os.path.join(self.root, STAGING, self.job, folder)
        os.makedirs(top, exist_ok=True)
        for batch in iterator:
            for path, given in zip(batch.column("source_path").to_pylist(), batch.column(self.given).to_pylist(), strict=True):
                to = os.path.normpath(os.path.join(top, path))
                if not to.startswith(top + os.sep):
                    raise ValueError(f"{path!r} is not inside the bundle")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                self.put(to, given)
        return Attempt(folder)

    def put(self, to: str, text: str | None) -> None:
        with open(to, "w", encoding="utf-8", newline="") as f:
            f.write(text or "")

    def commit(self, messages) -> None:
        top = os.path.join(self.root, STAGING, self.job)
        os.makedirs(top, exist_ok=True)
        with open(os.path.join(top, "committing"), "w", encoding="utf-8") as f:
            json.dump([m.folder for m in messages if m is not None], f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(os.path.join(top, "committing"), os.path.join(top, "committed"))
        _promote(self.root, self.job)

    def abort(self, messages) -> None:
        shutil.rmtree(os.path.join(self.root, STAGING, self.job), ignore_errors=True)
        _tidy(self.root)


class PieceWriter(BundleWriter):
    """Files from rows with source_path and pieces, each the path of a staged file; they are joined in order and stay."""

    given = "pieces"

    def put(self, to: str, pieces: list[str]) -> None:
        with open(to, "wb") as f:
            for piece in pieces:
                with open(piece, "rb") as g:
                    shutil.copyfileobj(g, f)


def pieces_of(batches, top: str):
    """Sorted lines to a file for each directory, in a folder of this attempt below ``top``: (dir, its first line's rank, type, step and name, file)."""
    import pyarrow as pa

    names = ["dir", "rank", "type", "step", "name"]
    folder, out, at, made = os.path.join(top, uuid.uuid4().hex), None, None, 0
    try:
        for batch in batches:
            rows = []
            for *key, text in zip(*(batch.column(n).to_pylist() for n in [*names, "text"]), strict=True):
                if out is None or key[0] != at:
                    if out is not None:
                        out.close()
                    piece = os.path.join(folder, str(made // 1000), str(made))
                    os.makedirs(os.path.dirname(piece), exist_ok=True)
                    out, at, made = open(piece, "w", encoding="utf-8", newline=""), key[0], made + 1  # noqa: SIM115
                    rows.append((*key, piece))
                out.write(text)
            types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [*names, "piece"])
    finally:
        if out is not None:
            out.close()


def _tidy(root: str) -> None:
    try:
        os.rmdir(os.path.join(root, STAGING))
    except OSError:
        pass  # another write is under way, or nothing was prepared


def _promote(root: str, job: str) -> None:
    """Moves the files of a recorded commit into place; doing it again does the rest."""
    top = os.path.join(root, STAGING, job)
    with open(os.path.join(top, "committed"), encoding="utf-8") as f:
        folders = json.load(f)

    def move(folder: str) -> None:
        own = os.path.join(top, folder)
        for here, _, files in os.walk(own):
            to = os.path.normpath(os.path.join(root, os.path.relpath(here, own)))
            os.makedirs(to, exist_ok=True)
            for name in files:
                os.replace(os.path.join(here, name), os.path.join(to, name))

    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(move, folders))
    shutil.rmtree(top)
    _tidy(root)


def forget(root: str, top: str) -> None:
    """Removes what was staged in ``top``, a folder below the staging folder of ``root``."""
    shutil.rmtree(top, ignore_errors=True)
    _tidy(root)


def recover(root: str) -> None:
    """Finishes commits that were recorded and then cut off. What no commit recorded stays where it is, out of sight."""
    try:
        jobs = sorted(os.listdir(os.path.join(root, STAGING)))
    except FileNotFoundError:
        return
    for job in jobs:
        if os.path.exists(os.path.join(root, STAGING, job, "committed")):
            _promote(root, job)


class BundleSource(DataSource):
    """Options: path; what: concepts (default), files, dirs or logs; listed: directories that the planner lists;
    prune: whether filters on the path reach the planner."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return {"files": FILES, "dirs": FILES, "logs": LOGS}.get(self.options.get("what", "concepts"), CONCEPTS)

    def reader(self, schema) -> BundleReader:
        return (PruningReader if self.options.get("prune") == "true" else BundleReader)(self.options, schema)

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        if overwrite:
            raise ValueError("a bundle is written with mode append: files of the same name are replaced, others stay")
        return (PieceWriter if "pieces" in schema.names else BundleWriter)(self.options["path"])
