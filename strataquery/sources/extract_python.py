"""Definitions, references and declaration shapes of Python sources, by the standard parser."""

from __future__ import annotations

import ast
from bisect import bisect_right

Definition = dict
Reference = dict


class Source:
    """A text with its line starts, in bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self.starts = [0]
        for line in data.splitlines(keepends=True) if b"\r" not in data else data.replace(b"\r\n", b"\0\n").replace(b"\r", b"\n").splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))

    def line(self, offset: int) -> int:
        """Line (from 1) of a byte."""
        return max(1, min(bisect_right(self.starts, offset), max(1, len(self.starts) - 1)))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].decode("utf-8", "replace")


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a chain of names, else None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return None


def parameters(args: ast.arguments) -> list[dict]:
    """Parameter shapes in order."""
    plain = [*args.posonlyargs, *args.args]
    free = len(plain) - len(args.defaults)
    out = [
        {"name": a.arg, "kind": "positional_only" if i < len(args.posonlyargs) else "positional", "required": i < free}
        for i, a in enumerate(plain)
    ]
    if args.vararg:
        out.append({"name": args.vararg.arg, "kind": "variadic", "required": False})
    out += [{"name": a.arg, "kind": "keyword_only", "required": d is None} for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    if args.kwarg:
        out.append({"name": args.kwarg.arg, "kind": "keyword_variadic", "required": False})
    return [p | {"position": i, "destructured": False} for i, p in enumerate(out)]


def call_shape(call: ast.Call) -> dict:
    return {
        "positional_count": sum(not isinstance(a, ast.Starred) for a in call.args),
        "keywords": [k.arg for k in call.keywords if k.arg],
        "has_positional_spread": any(isinstance(a, ast.Starred) for a in call.args),
        "has_keyword_spread": any(k.arg is None for k in call.keywords),
        "type_argument_count": 0,
        "is_constructor": False,
    }


class _Visitor(ast.NodeVisitor):
    def __init__(self, source: Source):
        self.source = source
        self.definitions: list[Definition] = []
        self.references: list[Reference] = []
        self._scope: list[tuple[str, str]] = []  # (name, function or class)

    # -- scopes -----------------------------------------------------------

    def _qualified(self) -> str:
        """Scope that a definition's name is put below: all of it inside functions, containers alone otherwise."""
        return ".".join(name for name, _ in self._scope)

    def _enter(self, node, kind: str) -> None:
        start, end = self.source.span(node)
        first = min([start, *(self.source.span(d)[0] - 1 for d in node.decorator_list)])
        within = self._scope[-1][1] if self._scope else ""
        shown = "method" if kind == "function" and within == "class" else kind
        parent = self._qualified()
        self.definitions.append({
            "kind": shown, "symbol": node.name, "qualified": ".".join(filter(None, [parent, node.name])), "parent": parent or None, "start": first, "end": end,
            "container": kind == "class", "parameters": parameters(node.args) if kind == "function" else [],
        })
        for d in node.decorator_list:
            target = d.func if isinstance(d, ast.Call) else d
            self._add("decorator", target)
            if isinstance(d, ast.Call):
                self._arguments(d)
        if kind == "class":
            for base in node.bases:
                named = base.value if isinstance(base, ast.Subscript) else base
                if dotted(named):
                    self._add("inheritance", named, inside=self.definitions[-1]["qualified"])
                    if named is not base:
                        self._types(base.slice)
                else:
                    self.visit(base)
            for k in node.keywords:
                self.visit(k.value)
        else:
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.args.vararg, node.args.kwarg]:
                if a is not None and a.annotation is not None:
                    self._types(a.annotation)
            for d in [*node.args.defaults, *(x for x in node.args.kw_defaults if x is not None)]:
                self.visit(d)
            if node.returns is not None:
                self._types(node.returns)
        self._scope.append((node.name, kind))
        for child in node.body:
            self.visit(child)
        self._scope.pop()

    def visit_FunctionDef(self, node):
        self._enter(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self._enter(node, "class")

    # -- references -------------------------------------------------------

    def _add(self, kind: str, node: ast.AST, *, target=None, written=None, module=None, imported=None, alias=None, receiver=None, shape=None, inside=None) -> None:
        start, end = self.source.span(node)
        name = target or dotted(node)
        if name is None:
            if not isinstance(node, ast.Attribute):
                return
            name = node.attr
        if receiver is None and isinstance(node, ast.Attribute):
            receiver = self.source.text(*self.source.span(node.value))
        self.references.append({
            "kind": kind, "target": name, "written": written or name, "module": module, "imported": imported, "alias": alias, "receiver": receiver,
            "start": start, "end": end, "source": inside if inside is not None else self._qualified(), "shape": shape,
        })

    def _types(self, node: ast.AST) -> None:
        """Names in a type expression; quoted ones are parsed."""
        for part in ast.walk(node):
            if isinstance(part, ast.Attribute) and dotted(part):
                self._add("type_use", part)
            elif isinstance(part, ast.Name):
                if not any(isinstance(p, ast.Attribute) and part in ast.walk(p) for p in ast.walk(node) if p is not part):
                    self._add("type_use", part)

    def visit_Import(self, node):
        for a in node.names:
            self._add("import", a, target=a.name, written=a.asname or a.name, module=a.name, alias=a.asname)

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self._add("import", a, target=a.name, written=a.asname or a.name, module=module, imported=a.name, alias=a.asname)

    def _arguments(self, call: ast.Call) -> None:
        for a in call.args:
            self.visit(a)
        for k in call.keywords:
            self.visit(k.value)

    def visit_Call(self, node):
        func = node.func
        if isinstance(func, (ast.Name, ast.Attribute)):
            self._add("call", func, shape=call_shape(node))
            if isinstance(func, ast.Attribute):
                self.visit(func.value)
        else:
            self.visit(func)
        self._arguments(node)

    def visit_Attribute(self, node):
        self._add("write" if isinstance(node.ctx, (ast.Store, ast.Del)) else "read", node)
        self.visit(node.value)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load):
            self._add("read", node)

    def visit_AnnAssign(self, node):
        self._types(node.annotation)
        self.visit(node.target)
        if node.value is not None:
            self.visit(node.value)

    def visit_Assign(self, node):
        named = [t.id for t in node.targets if isinstance(t, ast.Name)]
        if "__all__" in named and isinstance(node.value, (ast.List, ast.Tuple)) and not self._scope:
            for item in node.value.elts:
                if isinstance(item, ast.Constant) and isinstance(item.value, str):
                    self._add("export", item, target=item.value, written=item.value)
            return
        self.generic_visit(node)


def extract(data: bytes) -> tuple[list[Definition], list[Reference], bool]:
    """Definitions, references and whether the source has errors.

    A source that doesn't parse has no partial tree: it gets none of either.
    """
    bom = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    body = data[bom:]
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], [], True
    visitor = _Visitor(Source(body))
    visitor.visit(tree)
    for row in [*visitor.definitions, *visitor.references]:
        row["start"] += bom
        row["end"] += bom
    seen, unique = set(), []
    for r in visitor.references:
        key = (r["kind"], r["start"], r["end"])
        if key not in seen:
            seen.add(key)
            unique.append(r)
    return visitor.definitions, sorted(unique, key=lambda r: (r["start"], r["end"], r["kind"])), False
