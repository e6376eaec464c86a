"""Python source by its syntax tree."""

from __future__ import annotations

import ast
import posixpath

from graphloom.sources.facts import Facts, under

#: Calls that open the file named by their first argument.
OPENERS = ("open", "Path")


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes; what stands before other expressions is left out."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return ""


def constant_text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


class Walker(ast.NodeVisitor):
    """Functions are scopes, classes aren't: an edge starts at the innermost function or the file."""

    def __init__(self, facts: Facts):
        self.facts, self.scope = facts, [facts.path]
        self.imported: dict[str, list[str]] = {}

    def module_files(self, module: str, folder: str = "") -> list[str]:
        base = under(folder, module.replace(".", "/"))
        return [f"{base}.py", f"{base}/__init__.py"]

    def visit_Import(self, node: ast.Import) -> None:
        for name in node.names:
            files = self.module_files(name.name)
            self.imported[name.asname or name.name] = files
            self.facts.edge(self.facts.path, name.name, "imports", node.lineno, candidates=files)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module, files = node.module or "", []
        if module:
            folder = ""
            if node.level:
                folder = posixpath.dirname(self.facts.path)
                for _ in range(node.level - 1):
                    folder = posixpath.dirname(folder)
            files = self.module_files(module, folder)
            self.imported |= {name.asname or name.name: files for name in node.names}
        self.facts.edge(self.facts.path, module, "imports", node.lineno, candidates=files)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.facts.node(node.name, "function", node.lineno)
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.facts.node(node.name, "class", node.lineno)
        for base in node.bases:
            if name := dotted(base):
                self.facts.edge(node.name, name, "implements", node.lineno)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        if name := dotted(node.func):
            first, here = constant_text(node.args[0]) if node.args else None, self.scope[-1]
            if first is not None and "/" in first and name.rpartition(".")[2] in OPENERS:
                self.facts.edge(here, first, "reads", node.lineno)
            if first is not None and isinstance(node.func, ast.Attribute) and node.func.attr == "get" and (owner := dotted(node.func.value)):
                self.facts.edge(here, f"{owner}.{first}", "reads", node.lineno)
            self.facts.edge(here, name, "calls", node.lineno, candidates=self.imported.get(name.partition(".")[0]), rest=name)
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        key, owner = constant_text(node.slice), dotted(node.value)
        if key is not None and owner:
            self.facts.edge(self.scope[-1], f"{owner}.{key}", "reads", node.lineno)
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            if isinstance(target, ast.Subscript) and (key := constant_text(target.slice)) is not None and (owner := dotted(target.value)):
                self.facts.edge(self.scope[-1], f"{owner}.{key}", "writes", node.lineno)
        self.generic_visit(node)


def extract_python(path: str, text: str) -> Facts:
    """A file that can't be parsed is its file node alone."""
    facts = Facts(path)
    facts.node(path, "file", 0)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return facts
    Walker(facts).visit(tree)
    return facts
