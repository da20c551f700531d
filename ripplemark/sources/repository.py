"""Files of a repository's revisions.

``files`` has rev (``base`` or ``head``), path and text; only texts in UTF-8.
Git is asked on the driver for names alone. Contents of a commit come out of
one archive, written once as Parquet under the commit's id and reused; from
there on everything is distributed.
"""

from __future__ import annotations

import os
import subprocess
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, text string"
_SKIPPED = {"node_modules", "dist", "target"}


class GitError(RuntimeError):
    pass


def git(root: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    if done.returncode:
        raise GitError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def root_of(path: str) -> str:
    return git(path, "rev-parse", "--show-toplevel").decode().strip()


def commit_of(root: str, name: str) -> str:
    return git(root, "rev-parse", "--verify", f"{name}^{{commit}}").decode().strip()


def default_branch(root: str) -> str:
    """The remote's default branch, else the first of main and master that exists."""
    try:
        return git(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD").decode().strip()
    except GitError:
        for name in ("main", "master"):
            try:
                commit_of(root, name)
                return name
            except GitError:
                continue
    raise GitError("no default branch: name the base")


def merge_base(root: str, base: str, head: str = "HEAD") -> str:
    return git(root, "merge-base", base, head).decode().strip()


def cache_path(folder: str, sha: str) -> str:
    return os.path.join(folder, "trees", sha)


def commit_files(spark: SparkSession, root: str, sha: str, folder: str) -> DataFrame:
    """Files of a commit; written under ``folder`` the first time, read from there since."""
    path = cache_path(folder, sha)
    if not os.path.exists(os.path.join(path, "_SUCCESS")):
        spark.createDataFrame(list(_archived(root, sha)) or [], SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def _archived(root: str, sha: str):
    with subprocess.Popen(["git", "-C", root, "archive", "--format=tar", sha], stdout=subprocess.PIPE) as run:
        with tarfile.open(fileobj=run.stdout, mode="r|") as tar:
            for member in tar:
                if member.isfile():
                    try:
                        yield member.name, tar.extractfile(member).read().decode("utf-8")
                    except UnicodeDecodeError:
                        continue


def working_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of the working tree: tracked and untracked, neither ignored nor deleted."""
    names = git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").decode("utf-8", "replace").split("\0")
    rows = []
    for name in sorted(set(filter(None, names))):
        parts = name.split("/")[:-1]
        full = os.path.join(root, name)
        if _SKIPPED & set(parts) or any(p.startswith(".") for p in parts) or not os.path.isfile(full):
            continue
        try:
            with open(full, encoding="utf-8", newline="") as f:
                rows.append((name, f.read()))
        except (UnicodeDecodeError, OSError):
            continue
    return spark.createDataFrame(rows, SCHEMA)


def directory_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a directory of any file system, read by the executors."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    prefix = F.lit(path.rstrip("/").removeprefix("file://") + "/")
    name = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    text = F.col("content").cast("string")
    return read.where(F.is_valid_utf8(text)).select(F.substring(name, F.length(prefix) + 1, F.length(name)).alias("path"), text.alias("text"))


def versions(base: DataFrame, head: DataFrame) -> DataFrame:
    """(rev, path, text) of both revisions."""
    return base.select(F.lit("base").alias("rev"), "path", "text").unionByName(head.select(F.lit("head").alias("rev"), "path", "text"))


def cached_trees(folder: str) -> list[tuple[str, int]]:
    """(commit, bytes) of each tree under ``folder``."""
    top = os.path.join(folder, "trees")
    found = []
    for sha in sorted(os.listdir(top)) if os.path.isdir(top) else []:
        found.append((sha, sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(os.path.join(top, sha)) for f in fs)))
    return found
