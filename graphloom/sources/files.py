"""Lists of source files, and their texts as a DataFrame."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.extract import extractor_of
from graphloom.sources.manifests import MANIFESTS

#: Folders that a walk leaves out, besides those that begin with a dot.
SKIPPED = ("node_modules", "__pycache__", "target")
GIT_SECONDS = 10


def git_lines(root: str, *args: str) -> list[str]:
    """Output lines of git; none if it fails or takes too long."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=GIT_SECONDS, check=True)
    except (OSError, subprocess.SubprocessError):
        return []
    return [line for line in done.stdout.splitlines() if line]


def wanted(path: str) -> bool:
    return extractor_of(path) is not None or path.rpartition("/")[2] in MANIFESTS


def tracked_files(root: str) -> list[str]:
    """Files under version control that can be read, else those of a walk."""
    found = [p for p in git_lines(root, "ls-files") if wanted(p) and os.path.isfile(os.path.join(root, p))]
    return sorted(found or walked_files(root))


def walked_files(root: str) -> list[str]:
    out = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if not n.startswith(".") and n not in SKIPPED]
        out += [p for f in files if wanted(p := os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/"))]
    return sorted(out)


def changed_files(root: str, base: str = "HEAD~1") -> list[str]:
    return git_lines(root, "diff", "--name-only", base)


def changed_since(root: str, marker: str = ".pass_timestamp") -> list[str]:
    """Files changed since a marker file's time, else since ten commits ago; none without a marker, which
    a caller takes for all files."""
    at = os.path.join(root, marker)
    if not os.path.exists(at):
        return []
    since = git_lines(root, "log", f"--since=@{int(os.path.getmtime(at))}", "--name-only", "--diff-filter=ACMR", "--pretty=format:")
    return sorted(set(since)) or git_lines(root, "diff", "--name-only", "HEAD~10")


def literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_files(spark: SparkSession, root: str, project: str, paths: list[str]) -> DataFrame:
    """(project, path, content), read by Spark from a folder that the executors see."""
    if not paths:
        return spark.createDataFrame([], "project string, path string, content string")
    base = os.path.abspath(root).rstrip("/") + "/"
    texts = spark.read.text([literal(base + p) for p in paths], wholetext=True)
    place = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    path = F.substr("place", F.instr("place", base) + F.lit(len(base)))
    return texts.withColumn("place", place).select(F.lit(project).alias("project"), path.alias("path"), F.col("value").alias("content"))


#: Languages with a server, by extension.
SERVED = {".py": "python", ".ts": "typescript", ".tsx": "typescriptreact", ".js": "javascript", ".jsx": "javascriptreact", ".rs": "rust", ".go": "go", ".sol": "solidity"}


def by_language(spark: SparkSession, paths: list[str], language: str | None = None) -> DataFrame:
    """(path, extension, language) of files that a language server reads; folders that a walk leaves out
    are left out here too."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    named = rows.select("path", F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("extension"))
    of = F.create_map(*[F.lit(x) for pair in SERVED.items() for x in pair])
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in SKIPPED]))
    found = named.withColumn("language", of[F.col("extension")]).where(F.col("language").isNotNull() & ~skipped)
    return found.where(F.col("language") == language) if language else found
