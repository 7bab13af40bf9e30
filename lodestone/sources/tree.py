"""Source trees as tables: the walk, its limits, text and hashes."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import uuid5
from ..operators.persist import persisted

MAX_FILE, MAX_FILES, MAX_BYTES = 1 << 20, 100_000, 512 << 20
LISTED = "path string, size_bytes long"
SENSITIVE = re.compile(P.SENSITIVE.replace(r"\z", r"\Z"))  # the end of a text in this dialect


def limits() -> dict[str, int]:
    """The limits of a walk, as the environment sets them (bytes of a file, files, bytes in all)."""
    keys = {"max_file": ("LODESTONE_MAX_FILE_BYTES", MAX_FILE), "max_files": ("LODESTONE_MAX_FILES", MAX_FILES), "max_bytes": ("LODESTONE_MAX_REPO_BYTES", MAX_BYTES)}
    return {name: int(os.environ.get(key) or default) for name, (key, default) in keys.items()}


def glob_regex(glob: str) -> str:
    """One path segment of an ignore rule as a regular expression."""
    out = ""
    for piece in re.findall(r"\\.|\[[!^]?\]?[^\]]*\]|.", glob):
        if piece in "*?":
            out += "[^/]*" if piece == "*" else "[^/]"
        elif len(piece) > 1 and piece[0] == "[":
            out += re.sub(r"^\[[!^]", "[^/", piece)
        else:
            out += re.escape(piece[-1])
    return out


def ignore_rules(lines: list[str]) -> list[tuple[bool, bool, re.Pattern]]:
    """Ignore-file lines as (keeps, folders only, pattern over the path below the file's folder); the last that fits holds."""
    rules = []
    for line in lines:
        rule = re.sub(r"(?<!\\)\s+$", "", line)
        if not rule or rule.startswith("#"):
            continue
        keeps = rule.startswith("!")
        rule = rule[keeps:]
        folders, rule = rule.endswith("/"), rule.rstrip("/")
        if not rule:
            continue
        segments = rule.lstrip("/").split("/")
        body = "" if "/" in rule else "(?:.*/)?"
        for k, part in enumerate(segments):
            last = k == len(segments) - 1
            body += (".+" if last else "(?:.*/)?") if part == "**" else glob_regex(part) + ("" if last else "/")
        rules.append((keeps, folders, re.compile(body, re.S)))
    return rules


def verdict(rules: list[tuple[bool, bool, re.Pattern]], path: str, is_folder: bool) -> bool | None:
    """Whether the rules ignore a path; None if none fits."""
    for keeps, folders, pattern in reversed(rules):
        if (is_folder or not folders) and pattern.fullmatch(path):
            return not keeps
    return None


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a local path or a URI) and its path there."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def read_lines(store: fs.FileSystem, path: str) -> list[str]:
    if store.get_file_info(path).type != fs.FileType.File:
        return []
    with store.open_input_stream(path) as stream:
        return stream.read().decode("utf-8", "replace").splitlines()


class Ignores:
    """The ignore rules above an entry: ``.ignore`` files, then version control's files where there is a repository.

    Of each kind the nearest folder with a rule that fits decides. A user's
    global ignore file isn't read.
    """

    def __init__(self, store: fs.FileSystem, state: dict):
        self.store, self.state = store, state
        self.top, self.in_repository = state["top"], state["in_repository"]
        self.exclude = ignore_rules(state["exclude"])
        self.levels = {folder: (ignore_rules(plain), ignore_rules(git)) for folder, plain, git in state["levels"]}

    @classmethod
    def above(cls, store: fs.FileSystem, root: str) -> Ignores:
        """The rules that hold for a folder: its own and those of the folders above it in its repository."""
        ancestors = [PurePosixPath(root), *PurePosixPath(root).parents]
        repository = next((a for a in ancestors if store.get_file_info(f"{a}/.git").type != fs.FileType.NotFound), None)
        above = ancestors[: ancestors.index(repository) + 1] if repository else ancestors[:1]
        exclude = read_lines(store, f"{repository}/.git/info/exclude") if repository else []
        out = cls(store, {"top": str(above[-1]), "in_repository": repository is not None, "exclude": exclude, "levels": []})
        for folder in above:
            out = out.within(str(folder))
        return out

    def within(self, folder: str) -> Ignores:
        """The rules that hold within a folder of this one."""
        plain = read_lines(self.store, f"{folder}/.ignore")
        git = read_lines(self.store, f"{folder}/.gitignore") if self.in_repository else []
        if not plain and not git:
            return self
        return Ignores(self.store, {**self.state, "levels": [*self.state["levels"], (folder, plain, git)]})

    def ignored(self, path: str, is_folder: bool) -> bool:
        for kind in (0, 1):
            for folder in map(str, PurePosixPath(path).parents):
                rules = self.levels.get(folder, ([], []))[kind]
                found = verdict(rules, path[len(folder.rstrip("/")) + 1 :], is_folder) if rules else None
                if found is not None:
                    return found
        return bool(verdict(self.exclude, path[len(self.top.rstrip("/")) + 1 :], is_folder))


def language_of(path: str, more: dict[str, str] | None = None) -> str | None:
    """The language of a file name, as ``paths.language`` has it for columns; ``more`` adds extensions."""
    ext = PurePosixPath(path).name.rpartition(".")[2].lower() if "." in path else ""
    return next((name for name, exts in P.EXTENSIONS.items() if ext in exts), (more or {}).get(ext))


def entries(folder: str, state: str, root: str, max_file: int, more: dict[str, str]) -> Iterator[tuple[str, int | None, str | None]]:
    """What counts in one folder: (path, bytes, null) of files below the root, (path, null, rules) of folders to go into."""
    store, base = opened(root)
    ignores = Ignores(store, json.loads(state))
    for info in store.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.Directory:
            if info.base_name not in P.PRUNED_DIRECTORIES and not ignores.ignored(info.path, True):
                yield info.path, None, json.dumps(ignores.within(info.path).state)
        elif info.type == fs.FileType.File and language_of(info.base_name, more) and 0 < info.size <= max_file:
            path = info.path[len(base.rstrip("/")) + 1 :]
            if not ignores.ignored(info.path, False) and not SENSITIVE.search(path.replace("\\", "/").lower()):
                yield path, info.size, None


def listing(
    spark: SparkSession, root: str, max_file: int = MAX_FILE, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, more: dict[str, str] | None = None
) -> DataFrame:
    """(path below the folder, bytes) of the source files that count, names beginning with ``.`` or ``_`` too.

    Folders are rows that carry the ignore rules above them; each level of the tree is listed by one job. Empty,
    oversize and ignored files and pruned folders are passed over; too many files or bytes are an error, found as soon as
    a level goes beyond the limit.
    """
    store, base = opened(root)
    level = spark.createDataFrame([(base, json.dumps(Ignores.above(store, base).state))], "path string, rules string")
    out, files, size = None, 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, rules in zip(batch.column("path").to_pylist(), batch.column("rules").to_pylist()):
                found = list(entries(folder, rules, root, max_file, more or {}))
                for at in range(0, len(found), 4096):
                    columns = zip(*found[at : at + 4096])
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["path", "size_bytes", "rules"])

    while True:
        here = persisted(level.mapInArrow(run, f"{LISTED}, rules string"), "listing")
        folder = F.col("size_bytes").isNull()
        seen = here.agg(F.count_if(folder).alias("folders"), F.count_if(~folder).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
        files, size = files + seen["files"], size + seen["bytes"]
        if files > max_files:
            raise ValueError(f"too many files (over {max_files})")
        if size > max_bytes:
            raise ValueError(f"too many bytes in {files} files")
        own = here.where(~folder).select("path", "size_bytes")
        out = own if out is None else out.unionByName(own)
        if not seen["folders"]:
            return out
        level = here.where(folder).select("path", "rules").repartition(max(1, min(256, seen["folders"] // 16 + 1)))


def contents_of(names: DataFrame, root: str) -> DataFrame:
    """(path, size_bytes, content): the files of a listing, read by the executors that hold their names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{base}/{path}") as stream:
                    data = stream.read()
                yield pa.record_batch([pa.array([path]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["path", "size_bytes", "content"])

    return names.select("path").mapInArrow(read, "path string, size_bytes long, content binary")


def walk(
    spark: SparkSession, root: str, max_file: int = MAX_FILE, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, repository_id: str | None = None,
    more: dict[str, str] | None = None,
) -> DataFrame:
    """Files of the four languages below a folder: file_id, path, language, size_bytes, hash, text.

    Pruned directories, ignored, sensitive, empty and oversize files are left
    out; too many files or bytes are an error. Bytes that aren't UTF-8 become
    replacement characters. The folder must be one that all executors see.
    ``more`` names the languages of further extensions.
    """
    rows = persisted(listing(spark, root, max_file, max_files, max_bytes, more), "listed")
    names = rows.repartition(max(1, min(256, rows.count() // 64 + 1)), "path")
    language = P.language(F.col("path"))
    for extension, name in (more or {}).items():
        language = F.coalesce(language, F.when(F.lower(P.extension(F.col("path"))) == extension, F.lit(name)))
    read = contents_of(names, root).withColumn("language", language)
    text = F.decode("content", "UTF-8")
    file_id = uuid5(F.lit(repository_id), F.col("path")) if repository_id else F.sha1(F.col("path").cast("binary"))
    return read.select(file_id.alias("file_id"), "path", "language", "size_bytes", F.sha2("content", 256).alias("hash"), text.alias("text"))


def contents(files: DataFrame, path: str) -> DataFrame:
    """The file at a relative path; absolute, parent and sensitive paths are refused."""
    valid = files.sparkSession.range(1).select(P.is_valid_content_path(F.lit(path)).alias("ok")).first()["ok"]
    if not valid:
        raise ValueError(f"not a readable path: {path!r}")
    return files.where(F.col("path") == path).select("path", "text")
