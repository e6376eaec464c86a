"""Source in other languages by patterns: declarations, imports and calls, line by line of a rule table.

Calls are found by a scan of names before brackets, placed in the innermost block they stand in.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable

from graphloom.sources.facts import Facts, Lines, under

M = re.MULTILINE
CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_$][\w$]*\s*(?:\.|::)\s*)*[A-Za-z_$][\w$]*)\s*\(")
#: Words before a bracket that aren't calls.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "match", "loop", "else", "typeof", "new", "await", "super", "constructor", "sizeof", "defer", "go", "range", "select", "case", "in", "is", "as", "and", "or", "not", "require", "assert", "revert", "emit", "modifier", "event", "mapping", "import", "using", "impl", "use", "mod", "async", "returns")


def begin(path: str, line: int = 1) -> Facts:
    facts = Facts(path)
    facts.node(path, "file", line)
    return facts


def blank(text: str, pattern: re.Pattern) -> str:
    """Matches overwritten by spaces, so that offsets and lines stay."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


SLASH_COMMENTS = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)


def blocks(text: str, heads: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, name) of the braces that follow each head."""
    out = []
    for at, name in heads:
        start = text.find("{", at)
        if start < 0:
            continue
        depth = 0
        for m in re.compile(r"[{}]").finditer(text, start):
            depth += 1 if m.group() == "{" else -1
            if not depth:
                out.append((at, m.end(), name))
                break
    return out


DECLARES = re.compile(r"\b(?:function|func|fn|event|modifier|class|contract)\s*\*?\s*$")


def calls(facts: Facts, text: str, heads: list[tuple[int, str]], names: set[int], line: Callable[[int], int], target: Callable[[str], tuple[str, list[str], str | None, float] | None]) -> None:
    """Edges from the innermost block, or the file, to what ``target`` makes of each called name. names:
    where declared names stand."""
    spans = blocks(text, heads)
    for m in CALL.finditer(text):
        name = re.sub(r"\s+", "", m.group(1))
        if name in NOT_CALLS or m.start() in names or DECLARES.search(text, max(0, m.start() - 24), m.start()):
            continue
        found = target(name)
        if found:
            inside = [s for s in spans if s[0] <= m.start() < s[1]]
            here = min(inside, key=lambda s: s[1] - s[0])[2] if inside else facts.path
            what, candidates, rest, confidence = found
            facts.edge(here, what, "calls", line(m.start()), confidence, candidates, rest)


# ---- TypeScript and JavaScript

#: Extensions tried for an import, in order.
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Names that belong to the language or to test tools, not to the project.
SCRIPT_GLOBALS = ("console", "Math", "JSON", "Object", "Array", "Promise", "String", "Number", "Boolean", "Date", "Error", "Map", "Set", "Symbol", "RegExp", "parseInt", "parseFloat", "isNaN", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "require", "describe", "it", "test", "expect", "beforeEach", "afterEach", "beforeAll", "afterAll", "jest", "vi")
SCRIPT_IMPORT = re.compile(r"^import\s+(?!type\s)([^'\";]+?)\s+from\s+['\"]([^'\"]+)['\"]|^import\s+['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", M)
SCRIPT_DECLARED = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*(?P<function>\w+)|(?:abstract\s+)?class\s+(?P<class>\w+)(?:\s+extends\s+(?P<base>[\w.]+))?|(?:const|let|var)\s+(?P<arrow>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>)", M)
SCRIPT_METHOD = re.compile(r"^[ \t]+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?P<name>\w+)\s*\([^()\n]*\)\s*(?::\s*[^{\n]+)?\{", M)


def script_files(spec: str, folder: str) -> list[str]:
    """The files an import may mean, in order; none for a package."""
    if spec.startswith("@/"):
        base = under("", spec[2:])
    elif spec.startswith("."):
        base = under(folder, spec)
    else:
        return []
    return [base, *(base + x for x in SCRIPT_EXTENSIONS), *(f"{base}/index{x}" for x in SCRIPT_EXTENSIONS)]


def bindings(clause: str) -> list[tuple[str, str]]:
    """(local name, exported name) that an import clause binds; types left out."""
    out = []
    named = re.search(r"\{([^}]*)\}", clause)
    for part in named.group(1).split(",") if named else []:
        words = part.split()
        if words and words[0] != "type":
            out.append((words[-1], words[0]))
    head = clause.split("{")[0].strip().rstrip(",").strip()
    if star := re.match(r"\*\s+as\s+(\w+)", head):
        out.append((star.group(1), "*"))
    elif re.fullmatch(r"\w+", head):
        out.append((head, head))
    return out


def extract_script(path: str, text: str) -> Facts:
    facts = begin(posixpath.basename(path))
    facts.path = posixpath.basename(path)
    folder = posixpath.dirname(path)
    line, bare = Lines(text), blank(text, SLASH_COMMENTS)
    known: dict[str, tuple[list[str], str]] = {}
    for m in SCRIPT_IMPORT.finditer(bare):
        spec = m.group(2) or m.group(3) or m.group(4)
        files = script_files(spec, folder)
        facts.edge(facts.path, files[0] if files else spec, "imports", line(m.start()), candidates=files)
        if m.group(1) and files:
            known |= {local: (files, exported) for local, exported in bindings(m.group(1))}
    heads, objects, names = [], set(), set()
    for m in SCRIPT_DECLARED.finditer(bare):
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        name = m.group("function") or m.group("class") or m.group("arrow")
        facts.node(name, "class" if m.group("class") else "function", line(at))
        objects.add(name)
        if m.group("base"):
            facts.edge(name, m.group("base"), "implements", line(at))
        if not m.group("class"):
            heads.append((at, name))
    for m in SCRIPT_METHOD.finditer(bare):
        if m.group("name") not in NOT_CALLS:
            heads.append((m.start("name"), m.group("name")))
            names.add(m.start("name"))
            facts.node(m.group("name"), "function", line(m.start("name")))

    def target(name: str):
        first, _, rest = name.partition(".")
        if first in SCRIPT_GLOBALS or re.match(r"set[A-Z]", first):
            return None
        if first in known:
            files, exported = known[first]
            return name, files, name.rpartition(".")[2] if rest else exported, 1.0
        if not rest:
            return name, [], None, 1.0
        return (rest.rpartition(".")[2], [], None, 0.9) if first in objects or first == "this" else None

    calls(facts, bare, heads, names, line, target)
    return facts


# ---- Rust

RUST_USE = re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+(?:::\{[^}]+\})?)\s*;", M)
RUST_MOD = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*[;{]", M)
RUST_ITEM = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn\s+(?P<fn>\w+)|(?:struct|enum|trait)\s+(?P<type>\w+))", M)
RUST_IMPL = re.compile(r"^\s*impl(?:<[^>]*>)?\s+(\w+(?:::\w+)*)(?:<[^>]*>)?(?:\s+for\s+(\w+(?:::\w+)*))?", M)


def rust_files(parts: list[str], folder: str) -> list[str]:
    """Files of a use path: of its longest head that may be a module, a.rs before a/mod.rs."""
    root, rest = "", parts
    if parts[0] == "crate":
        root, rest = "src", parts[1:]
    elif parts[0] in ("self", "super"):
        root = folder
        while rest and rest[0] in ("self", "super"):
            root, rest = (posixpath.dirname(root) if rest[0] == "super" else root), rest[1:]
    else:
        return []
    out = []
    for n in range(len(rest), 0, -1):
        base = under(root, "/".join(rest[:n]))
        out += [f"{base}.rs", f"{base}/mod.rs"]
    return out


def extract_rust(path: str, text: str) -> Facts:
    facts, line, bare, folder = begin(path), Lines(text), blank(text, SLASH_COMMENTS), posixpath.dirname(path)
    at = lambda m: m.start() + len(m.group()) - len(m.group().lstrip())
    for m in RUST_USE.finditer(bare):
        facts.edge(path, m.group(1), "imports", line(at(m)), candidates=rust_files(re.sub(r"::\{.*", "", m.group(1), flags=re.S).split("::"), folder))
    for m in RUST_MOD.finditer(bare):
        base = under(folder, m.group(1))
        facts.edge(path, m.group(1), "imports", line(at(m)), candidates=[f"{base}.rs", f"{base}/mod.rs"])
    heads = []
    names: set[int] = set()
    for m in RUST_ITEM.finditer(bare):
        name = m.group("fn") or m.group("type")
        facts.node(name, "function" if m.group("fn") else "class", line(at(m)))
        if m.group("fn"):
            heads.append((at(m), name))
    for m in RUST_IMPL.finditer(bare):
        if m.group(2):
            facts.edge(m.group(2), m.group(1), "implements", line(at(m)))
    calls(facts, bare, heads, names, line, lambda name: (name, [], None, 1.0))
    return facts


# ---- Go

GO_IMPORTS = re.compile(r"^import\s*\(([^)]*)\)|^import\s+(?:[\w.]+\s+)?(\"[^\"]+\")", M)
GO_QUOTED = re.compile(r"\"([^\"]+)\"")
GO_ITEM = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?(?P<on>\w+)[^)]*\)\s*)?(?P<func>\w+)|^type\s+(?P<type>\w+)", M)


def extract_go(path: str, text: str) -> Facts:
    facts, line, bare = begin(path), Lines(text), blank(text, SLASH_COMMENTS)
    for block in GO_IMPORTS.finditer(bare):
        for m in GO_QUOTED.finditer(block.group()):
            facts.edge(path, m.group(1), "imports", line(block.start() + m.start()))
    heads, names = [], set()
    for m in GO_ITEM.finditer(bare):
        name = m.group("func") or m.group("type")
        facts.node(name, "function" if m.group("func") else "class", line(m.start()))
        if m.group("func"):
            heads.append((m.start(), name))
            names.add(m.start("func"))
        if m.group("on"):
            facts.edge(name, m.group("on"), "implements", line(m.start()))
    calls(facts, bare, heads, names, line, lambda name: (name, [], None, 1.0))
    return facts


# ---- Protocol buffers

#: Field types that name nothing.
PROTO_SCALARS = ("double", "float", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "bool", "string", "bytes")
PROTO = re.compile(
    r"^\s*import\s+(?:public\s+|weak\s+)?\"(?P<import>[^\"]+)\"|^\s*service\s+(?P<service>\w+)|^\s*(?:message|enum)\s+(?P<message>\w+)"
    r"|^\s*rpc\s+(?P<rpc>\w+)\s*\(\s*(?:stream\s+)?(?P<asked>[\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?(?P<given>[\w.]+)"
    r"|^\s*option\s+go_package\s*=\s*\"(?P<package>[^\"]+)\"|^\s*(?:repeated\s+|optional\s+|required\s+)?(?P<field>\w+(?:\.\w+)*)\s+\w+\s*=\s*\d+", M)  # fmt: skip


def extract_proto(path: str, text: str) -> Facts:
    """Lines are those of the text with its comments: here comments are blanked, not cut out."""
    facts, line = begin(path), Lines(text)
    for m in PROTO.finditer(blank(text, re.compile(r"//[^\n]*"))):
        at, kind = line(m.start() + len(m.group()) - len(m.group().lstrip())), m.lastgroup
        if m.group("import"):
            facts.edge(path, m.group("import"), "imports", at)
        elif m.group("service") or m.group("message"):
            facts.node(m.group("service") or m.group("message"), "class", at)
        elif m.group("rpc"):
            facts.node(m.group("rpc"), "function", at)
            for side in ("asked", "given"):
                facts.edge(m.group("rpc"), m.group(side), "calls", at)
        elif m.group("package"):
            facts.edge(path, m.group("package"), "implements", at)
        elif kind == "field":
            base = m.group("field").rpartition(".")[2]
            if base[0].isupper() and base.lower() not in PROTO_SCALARS:
                facts.edge(path, base, "reads", at)
    return facts


# ---- Shell

HEREDOC = re.compile(r"<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n(.*?)^\s*\1\s*$", M | re.S)
SHELL = re.compile(r"^[ \t]*(?:source|\.)[ \t]+(?:[\"'](?P<quoted>[^\"'\n]+)[\"']|(?P<bare>[^\s;#]+))|^[ \t]*function\s+(?P<word>[\w-]+)|^[ \t]*(?P<paren>[\w-]+)\s*\(\s*\)\s*\{?", M)


def extract_shell(path: str, text: str) -> Facts:
    facts, line = begin(path), Lines(text)
    kept, seen = blank(text, HEREDOC), set()
    for m in SHELL.finditer(kept):
        at = line(m.start() + len(m.group()) - len(m.group().lstrip()))
        spec, name = m.group("quoted") or m.group("bare"), m.group("word") or m.group("paren")
        if spec:
            facts.edge(path, spec, "imports", at, 0.7 if "$" in spec else 1.0)
        elif (name, at) not in seen:
            seen.add((name, at))
            facts.node(name, "function", at)
    return facts


# ---- Solidity

SOLIDITY = re.compile(
    r"^\s*(?:abstract\s+)?(?:contract|interface|library)\s+(?P<contract>\w+)(?:\s+is\s+(?P<bases>[^{]+))?|^\s*function\s+(?P<function>\w+)\s*\([^)]*\)\s*(?:\w+\s*)*?(?:public|external)\b"
    r"|^\s*event\s+(?P<event>\w+)\s*\(|^\s*modifier\s+(?P<modifier>\w+)|^\s*(?:mapping\s*\([^;]*\)|\w+(?:\[\])?)\s+public\s+(?:constant\s+|immutable\s+)?(?P<variable>\w+)", M)  # fmt: skip


def extract_solidity(path: str, text: str) -> Facts:
    facts, line, bare = begin(path), Lines(text), blank(text, SLASH_COMMENTS)
    heads, names = [], set()
    for m in SOLIDITY.finditer(bare):
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        if m.group("contract"):
            facts.node(m.group("contract"), "class", line(at))
            for base in m.group("bases").split(",") if m.group("bases") else ():
                names.add(m.start("bases") + m.group("bases").find(base.strip()))
                if name := re.sub(r"\(.*", "", base.strip(), flags=re.S):
                    facts.edge(m.group("contract"), name, "implements", line(at))
            continue
        kind = next(k for k in ("function", "event", "modifier", "variable") if m.group(k))
        facts.node(m.group(kind), kind, line(at))
        if kind == "function":
            heads.append((at, m.group(kind)))
    calls(facts, bare, heads, names, line, lambda name: (name, [], None, 1.0))
    return facts
