"""Version control as a source: materialising a repository, log, branch and diff lines."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history

LOG_LIMIT, CLONE_DEPTH = 400, 250
FORMAT = "%H%x1f%an%x1f%ae%x1f%at%x1f%s"


def git(root: str | Path, *args: str) -> str:
    done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, check=True)
    return done.stdout


TRANSPORTS = re.compile(r"(?:https?|ssh|git|file)://|[\w.-]+@[\w.-]+:")
"""What may be cloned: these transports, or ``user@host:path``; helpers that run commands aren't among them."""


def canonical(spec: str) -> str:
    """What a repository is known by: the resolved path of a local folder, else the URL as it is."""
    local = Path(spec)
    return str(local.resolve()) if local.exists() else spec


def materialize(spec: str, cache: str) -> dict[str, str]:
    """A local folder, or a clone in the cache: root, name, branch and sha."""
    local = Path(spec)
    if local.exists():
        root = local.resolve()
    else:
        name = re.sub(r"\.git$", "", spec.rstrip("/")).rpartition("/")[2]
        root = Path(cache) / name
        if root.exists():
            git(root, "fetch", "--all", "--prune")
        elif not TRANSPORTS.match(spec):
            raise ValueError(f"neither a folder nor a repository that can be cloned: {spec}")
        else:
            subprocess.run(["git", "clone", "--depth", str(CLONE_DEPTH), "--", spec, str(root)], check=True, capture_output=True)
    try:
        branch, sha = git(root, "rev-parse", "--abbrev-ref", "HEAD").strip(), git(root, "rev-parse", "HEAD").strip()
    except subprocess.CalledProcessError:
        branch, sha = "HEAD", "working-tree"
    return {"root": str(root), "name": root.name, "branch": branch, "sha": sha, "url": canonical(spec)}


def line_table(spark: SparkSession, text: str) -> DataFrame:
    rows = [("", i, line) for i, line in enumerate(text.split("\n")) if line]
    return spark.createDataFrame(rows, "repo string, ord int, line string")


def prefix_of(root: str) -> str:
    """Where a folder lies within its repository: empty at the top, or outside of any."""
    try:
        return git(root, "rev-parse", "--show-prefix").strip().rstrip("/")
    except subprocess.CalledProcessError:
        return ""


def touches(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """The latest commits that aren't merges with their paths, below ``prefix`` if there is one; none outside a repository."""
    try:
        below = ["--", f":(top){prefix}"] if prefix else []
        text = git(root, "log", f"-n{LOG_LIMIT}", "--no-merges", f"--format={FORMAT}", "--name-only", *below)
    except subprocess.CalledProcessError:
        text = ""
    return history.parse_log(line_table(spark, text), prefix)


def branches(spark: SparkSession, root: str) -> DataFrame:
    """Local branches, the one checked out first; none outside a repository."""
    try:
        text = git(root, "for-each-ref", "refs/heads", "--format=%(refname:short)%1f%(objectname)")
        default = git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
    except subprocess.CalledProcessError:
        text, default = "", ""
    return history.parse_branches(line_table(spark, text), default).orderBy(F.desc("is_default"), "name")


def changes(spark: SparkSession, root: str, since: str, until: str, prefix: str = "") -> DataFrame:
    """What changed between two commits and in the working tree, below ``prefix`` if there is one."""
    below = ["--", f":(top){prefix}"] if prefix else []
    ranged = history.parse_name_status(line_table(spark, git(root, "diff", "--name-status", "--find-renames", since, until, *below)), prefix)
    tree = history.parse_porcelain(line_table(spark, git(root, "status", "--porcelain", "-uall", *below)), prefix)
    return history.merged_diff(ranged, tree)
