"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a path that mark a test file.
TEST_SEGMENTS = ("test/", "tests/", "spec/", "specs/", "__tests__/", "__test__/", "test_", ".test.", ".spec.", "_test.", "_spec.")


def is_test_file(file: Column) -> Column:
    lower, found = F.lower(file), F.lit(False)
    for s in TEST_SEGMENTS:
        found = found | lower.contains(s)
    return found


def split_camel(name: Column) -> Column:
    """Pieces between capitals, underscores, hyphens and dots, lower-cased; a name without any is whole."""
    cut = F.regexp_replace(F.regexp_replace(name, "(?<=[^_.-])(?=\\p{Lu})", "_"), "[_.-]+", "_")
    parts = F.filter(F.split(F.lower(cut), "_"), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(name))


def parted(name: Column, mark: str) -> Column:
    """The name with a mark before each capitalised word inside it."""
    inner = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", f"$1{mark}$2")
    return F.regexp_replace(inner, "([a-z])([A-Z])", f"$1{mark}$2")


def name_tokens(name: Column) -> Column:
    """Distinct lower-case words of three letters or more: capitalised words, runs of capitals, of small
    letters or of digits."""
    numbers = F.regexp_replace(parted(name, " "), "([0-9]+)", " $1 ")
    words = F.split(F.lower(numbers), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def camel_to_kebab(name: Column) -> Column:
    return F.lower(parted(name, "-"))


def strip_version(spec: Column) -> Column:
    """The name in a requirement such as ``name[extra]>=1``."""
    return F.trim(F.split(spec, r"[\[>=<~!;]")[0])


def uri_to_path(uri: Column, root: str) -> Column:
    """A file URI as a path under root; null outside it."""
    path = F.url_decode(F.regexp_replace(uri, "^file://", ""))
    return relative_to(path, root)


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20))


def kind_to_type(kind: Column) -> Column:
    """Symbol kinds of language servers as node types. 5 class, 6 and 12 function, 13 field."""
    return F.when(kind == 5, "class").when(kind.isin(6, 12), "function").when(kind == 13, "field").otherwise("function")


def process_label(entry: Column, terminal: Column) -> Column:
    return F.concat(entry, F.lit(" → "), terminal)


def path_of_match(raw: Column) -> Column:
    """A route's path from the part of a file name: without the extension, slashes forward."""
    return F.translate(F.regexp_replace(raw, r"\.(ts|js|tsx|jsx|mjs|py|rs|go|java|rb|php|cs)$", ""), "\\", "/")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1

