"""Definitions and references of other languages, by lexical patterns.

Coarser than a parser: comments and strings are blanked, definitions are found
by their head, blocks by matching braces, indentation or ``end``. Structural
references are given for the script family only.
"""

from __future__ import annotations

import re

_NAME = r"[A-Za-z_$][\w$]*"

# Heads of definitions: kind and a pattern whose group is the name.
_SCRIPT = [
    ("class", rf"\bclass\s+({_NAME})"),
    ("function", rf"\bfunction\s*\*?\s*({_NAME})\s*[(<]"),
    ("function", rf"\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=;{{]+)?=>|{_NAME}\s*=>)"),
    ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?!(?:if|for|while|switch|catch|return|function|else|do|new|await|typeof)\b)(#?{_NAME})\s*(?:<[^>(]*>)?\((?:[^;{{}}()]|\{{[^{{}}]*\}}|\([^()]*\))*\)\s*(?::[^;{{}}=]+)?\{{"),
]
_TYPED = [*_SCRIPT, ("interface", rf"\binterface\s+({_NAME})"), ("type", rf"\btype\s+({_NAME})\s*(?:<[^=]*>)?\s*="), ("enum", rf"\benum\s+({_NAME})")]
HEADS: dict[str, list[tuple[str, str]]] = {
    "javascript": _SCRIPT, "typescript": _TYPED, "tsx": _TYPED,
    "java": [
        ("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("record", r"\brecord\s+(\w+)\s*[(<]"), ("annotation", r"@interface\s+(\w+)"),
        ("method", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s+)?(?!(?:return|new|else|throw)\b)[\w.<>\[\],?]+\s+(\w+)\s*\([^;{}]*\)\s*(?:throws [\w., ]+)?\{"),
        ("constructor", r"^[ \t]+(?:public|private|protected)\s+([A-Z]\w*)\s*\([^;{}]*\)\s*\{"),
    ],
    "csharp": [
        ("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("record", r"\brecord\s+(?:class\s+|struct\s+)?(\w+)"),
        ("method", r"^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|partial)\s+)+[\w.<>\[\],?]+\s+(\w+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?:\{|=>)"),
        ("constructor", r"^[ \t]+(?:public|private|protected|internal)\s+([A-Z]\w*)\s*\([^;{}]*\)\s*(?::[^{]*)?\{"), ("property", r"^[ \t]+(?:public|private|protected|internal)\s+(?:static\s+)?[\w.<>\[\],?]+\s+(\w+)\s*\{\s*(?:get|set|init)\b"),
    ],
    "go": [("function", r"^func\s+(\w+)\s*[(\[]"), ("method", r"^func\s+\([^)]*\)\s*(\w+)\s*\("), ("struct", r"\btype\s+(\w+)\s+struct\b"), ("interface", r"\btype\s+(\w+)\s+interface\b"), ("type", r"\btype\s+(\w+)\s+(?!struct\b|interface\b)\S")],
    "rust": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("interface", r"\btrait\s+(\w+)"), ("type", r"\btype\s+(\w+)\s*[=<]"), ("module", r"\bmod\s+(\w+)\s*\{"), ("class", r"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"), ("constant", r"\b(?:const|static)\s+([A-Z_][A-Z0-9_]*)\s*:")],
    "c": [("function", r"^(?!(?:typedef|return|else|#)\b)[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{}]*\)\s*\{"), ("struct", r"\bstruct\s+(\w+)\s*\{"), ("enum", r"\benum\s+(\w+)\s*\{"), ("type", r"\btypedef\b[^;{]*?(\w+)\s*;")],
    "cpp": [("class", r"\bclass\s+(\w+)\s*(?:final\s*)?[:{]"), ("struct", r"\bstruct\s+(\w+)\s*[:{]"), ("enum", r"\benum\s+(?:class\s+)?(\w+)\s*[:{]"), ("function", r"^(?!(?:typedef|return|else|#|namespace)\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&]((?:\w+::)*~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{")],
    "lua": [("function", r"\bfunction\s+([\w.:]+)\s*\(")],
    "sql": [("table", r"(?i)\bcreate\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"), ("view", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"), ("function", r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.\"]+)"), ("index", r"(?i)\bcreate\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"), ("trigger", r"(?i)\bcreate\s+(?:or\s+replace\s+)?trigger\s+([\w.\"]+)"), ("type", r"(?i)\bcreate\s+type\s+([\w.\"]+)")],
    "terraform": [("object", r"^(?:resource|data)\s+\"[^\"]+\"\s+\"([^\"]+)\""), ("object", r"^(?:module|variable|output|provider)\s+\"([^\"]+)\""), ("object", r"^(locals|terraform)\s*\{")],
    "yaml": [("property", r"^([\w.-]+)\s*:")],
    "json": [("property", r"^(?:\t| {1,4})\"([^\"]+)\"\s*:")],
    "gdscript": [("class", r"^class(?:_name)?\s+(\w+)"), ("function", r"^[ \t]*(?:static\s+)?func\s+(\w+)"), ("signal", r"^signal\s+(\w+)"), ("enum", r"^enum\s+(\w+)"), ("constant", r"^const\s+(\w+)"), ("property", r"^(?:@\w+(?:\([^)]*\))?\s+)*var\s+(\w+)")],
    "gdshader": [("function", r"^\s*(?:void|float|int|bool|[iu]?vec[234]|mat[234])\s+(\w+)\s*\("), ("property", r"^\s*uniform\s+\w+\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)")],
    "godot_resource": [("object", r"^\[(?:node|resource|sub_resource|ext_resource)\b[^\]]*?(?:name|id)=\"([^\"]+)\""), ("object", r"^\[(\w+)\]")],
}

SCRIPTS = ("javascript", "typescript", "tsx")
_CONTAINERS = {"class", "interface", "struct", "enum", "record", "module", "object"}
_INDENTED = {"gdscript", "yaml"}
_FLAT = {"sql", "godot_resource", "json"}
_COMMENTS = {"lua": r"--\[\[.*?\]\]|--[^\n]*", "sql": r"--[^\n]*|/\*.*?\*/", "yaml": r"#[^\n]*", "gdscript": r"#[^\n]*", "terraform": r"#[^\n]*|//[^\n]*|/\*.*?\*/", "json": r"(?!)", "godot_resource": r"^;[^\n]*"}
_KEYWORDS = frozenset("if for while switch catch return function else do new await typeof in of case throw delete void yield import export class extends super this const let var async static get set default from as instanceof break continue try finally null true false undefined".split())


def blanked(text: str, language: str, strings: bool = True) -> str:
    """``text`` with comments (and contents of strings) as spaces, so that offsets stay."""
    comment = _COMMENTS.get(language, r"//[^\n]*|/\*.*?\*/")
    literal = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'" + (r"|`(?:\\.|[^`\\])*`" if language in SCRIPTS else "")
    if language in ("rust", "lua", "c", "cpp", "gdshader"):
        literal = literal.replace(r"|'(?:\\.|[^'\\\n])*'", r"|'(?:\\.|[^'\\\n])'" if language == "rust" else r"|'(?:\\.|[^'\\\n])*'")
    wipe = lambda s: re.sub(r"[^\n]", " ", s)

    def one(m: re.Match) -> str:
        if m["comment"] is not None:
            return wipe(m[0])
        return m[0][0] + wipe(m[0][1:-1]) + m[0][-1] if strings else m[0]

    return re.sub(rf"(?P<literal>{literal})|(?P<comment>{comment})", one, text, flags=re.S | re.M)


def _block_end(text: str, start: int, language: str) -> int:
    """End of the definition whose head starts at ``start``."""
    line_end = text.find("\n", start)
    line_end = len(text) if line_end < 0 else line_end
    if language in _INDENTED:
        begin = text.rfind("\n", 0, start) + 1
        indent = len(text[begin:start]) - len(text[begin:start].lstrip())
        at = line_end
        for line in text[line_end + 1 :].splitlines(keepends=True):
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            at += len(line)
        return min(len(text), len(text[:at].rstrip()) or at)
    if language == "lua":
        depth = 0
        for m in re.finditer(r"\b(function|if|for|while|do|repeat|end|until)\b", text[start:]):
            word = m[0]
            depth += {"function": 1, "if": 1, "for": 1, "while": 1, "repeat": 1, "end": -1, "until": -1}.get(word, 0)
            if depth == 0:
                return start + m.end()
        return len(text)
    if language in _FLAT:
        end = text.find(";", start) if language == "sql" else line_end
        return (len(text) if end < 0 else end + (language == "sql"))
    depth, i = 0, start
    for i in range(start, len(text)):
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and depth == 0 and text.count("(", start, i) == text.count(")", start, i):
            return i + 1
    return len(text) if depth else line_end


def definitions(text: str, language: str) -> list[dict]:
    """Definitions in order; names are qualified by the definitions around them."""
    clean = blanked(text, language, strings=language not in ("terraform", "json", "godot_resource", "sql"))
    found: dict[int, dict] = {}
    for kind, head in HEADS.get(language, []):
        for m in re.finditer(head, clean, flags=re.M):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            name = m[1].strip('"')
            if name in _KEYWORDS and language in SCRIPTS:
                continue
            found.setdefault(m.start(1), {"kind": kind, "symbol": name, "start": start, "end": max(m.end(), _block_end(clean, start, language)), "container": kind in _CONTAINERS, "parameters": []})
    rows = sorted(found.values(), key=lambda d: (d["start"], -d["end"]))
    stack: list[dict] = []
    for d in rows:
        while stack and stack[-1]["end"] <= d["start"]:
            stack.pop()
        around = [s for s in stack if s["end"] >= d["end"]]
        scope = around if any(not s["container"] for s in around) else [s for s in around if s["container"]]
        d["parent"] = ".".join(s["symbol"] for s in scope) or None
        d["qualified"] = ".".join([*(s["symbol"] for s in scope), d["symbol"]])
        if d["kind"] == "function" and around and around[-1]["container"] and language not in ("rust",):
            d["kind"] = "method"
        elif d["kind"] == "function" and language == "rust" and around and around[-1]["kind"] == "class":
            d["kind"] = "method"
        if language in SCRIPTS and d["kind"] in ("function", "method"):
            d["parameters"] = _parameters(clean, d["start"], d["end"])
        stack.append(d)
    return rows


def _split(body: str) -> list[str]:
    """Parts between commas that no bracket holds."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c in "([{<") - (c in ")]}") - (c == ">" and body[i - 1 : i] != "=")
        if c == "," and depth <= 0:
            out.append(body[last:i])
            last = i + 1
    return [p.strip() for p in [*out, body[last:]] if p.strip()]


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if depth == 0:
            return i
    return len(text)


def _parameters(clean: str, start: int, end: int) -> list[dict]:
    at = clean.find("(", start, end)
    if at < 0:
        return []
    out = []
    for i, part in enumerate(_split(clean[at + 1 : _closing(clean, at)])):
        part = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", part)
        rest, inner = part.startswith("..."), part.removeprefix("...")
        torn = inner[:1] in "{["
        name = inner[: _closing(inner, 0) + 1] if torn else re.match(rf"{_NAME}|", inner)[0]
        tail = inner[len(name) :]
        out.append({"name": name, "kind": "variadic" if rest else "positional", "required": not rest and not tail.lstrip().startswith("?") and "=" not in tail.replace("=>", ""), "position": i, "destructured": torn})
    return out


def references(text: str, language: str, defined: list[dict]) -> list[dict]:
    """Imports, exports, heritage, calls, member uses and JSX of scripts."""
    if language not in SCRIPTS:
        return []
    code, whole = blanked(text, language), blanked(text, language, strings=False)
    heads = {d["start"] for d in defined}
    out: list[dict] = []
    taken: set[int] = set()

    def inside(at: int) -> str:
        around = [d for d in defined if d["start"] <= at < d["end"]]
        return around[-1]["qualified"] if around else ""

    def add(kind: str, start: int, end: int, target: str, **more) -> None:
        out.append({"kind": kind, "start": start, "end": end, "target": target, "written": target, "module": None, "imported": None, "alias": None, "receiver": None, "shape": None, "source": inside(start)} | more)
        taken.add(start)

    for m in re.finditer(r"\bimport\s+(?:type\s+)?(?:([^'\";]*?)\s+from\s+)?(['\"])([^'\"\n]+)\2", whole):
        clause, module, begin = m[1], m[3], m.start()
        if clause is None:
            add("import", begin, m.end(), module, module=module)
            continue
        at = m.start(1)
        taken.update(range(at, at + len(clause)))
        named = re.search(r"\{([^}]*)\}", clause)
        for x in re.finditer(rf"({_NAME})(?:\s+as\s+({_NAME}))?", named[1] if named else ""):
            if x[1] != "type" or x[2]:
                s = at + named.start(1) + x.start()
                add("import", s, s + len(x[0]), x[1], written=x[2] or x[1], module=module, imported=x[1], alias=x[2])
        outer = clause[: named.start()] + " " * len(named[0]) + clause[named.end() :] if named else clause
        if x := re.search(rf"\*\s+as\s+({_NAME})", outer):
            add("import", at + x.start(), at + x.end(), "*", written=x[1], module=module, imported="*", alias=x[1])
            outer = outer[: x.start()] + " " * len(x[0]) + outer[x.end() :]
        if x := re.search(_NAME, outer):
            add("import", at + x.start(), at + x.end(), x[0], module=module, imported="default", written=x[0], alias=x[0])
    for m in re.finditer(r"\bexport\s+(?:type\s+)?(?:\{([^}]*)\}|\*(?:\s+as\s+(" + _NAME + r"))?)(?:\s*from\s*(['\"])([^'\"\n]+)\3)?", whole):
        module = m[4]
        if m[1] is None:
            add("export", m.start(), m.end(), "*", written=m[2] or "*", module=module, imported="*", alias=m[2])
        for x in re.finditer(rf"({_NAME})(?:\s+as\s+({_NAME}))?", m[1] or ""):
            s = m.start(1) + x.start()
            add("export", s, s + len(x[0]), x[1], written=x[2] or x[1], module=module, imported=x[1], alias=x[2])
            taken.update(range(s, s + len(x[0])))
    for m in re.finditer(rf"\bexport\s+(default\s+)?(?:async\s+)?(?:abstract\s+)?(?:class|function\s*\*?|const|let|var|interface|type|enum)\s+({_NAME})", code):
        add("export", m.start(2), m.end(2), m[2], alias="default" if m[1] else None)
    for m in re.finditer(rf"\b(?:require|import)\s*\(\s*(['\"])([^'\"\n]+)\1\s*\)", whole):
        add("import", m.start(), m.end(), m[2], module=m[2])
    for m in re.finditer(rf"\bclass\s+({_NAME})[^{{]*?\bextends\s+({_NAME}(?:\.{_NAME})*)", code):
        owner = next((d["qualified"] for d in defined if d["symbol"] == m[1] and d["start"] <= m.start(1) < d["end"]), m[1])
        add("inheritance", m.start(2), m.end(2), m[2], source=owner)
    for m in re.finditer(rf"\bimplements\s+([^{{]+)\{{", code):
        for x in re.finditer(rf"{_NAME}(?:\.{_NAME})*", m[1]):
            add("type_use", m.start(1) + x.start(), m.start(1) + x.end(), x[0])
    for m in re.finditer(rf"@({_NAME}(?:\.{_NAME})*)", code):
        add("decorator", m.start(1), m.end(1), m[1])
    for m in re.finditer(rf"(?<![\w$.])(new\s+)?((?:this\.|super\.)?{_NAME}(?:\??\.{_NAME})*)\s*(<[\w\s,.\[\]]*>)?\(", code):
        name = m[2].replace("?.", ".")
        if name.split(".")[-1] in _KEYWORDS or m.start(2) in taken or any(s <= m.start() and m.start() - s < 40 and code[s : m.start(2)].split()[-1:] in (["function"], ["*"]) for s in heads):
            continue
        if any(d["start"] == m.start() or (d["kind"] == "method" and d["start"] <= m.start(2) < d["start"] + 60 and d["symbol"] == name and code[d["start"] : m.start(2)].strip() in ("", "async", "static", "get", "set")) for d in defined):
            continue
        close = _closing(code, m.end() - 1)
        arguments = _split(code[m.end() : close])
        spread = any(a.startswith("...") for a in arguments)
        shape = {"positional_count": sum(not a.startswith("...") for a in arguments), "keywords": [], "has_positional_spread": spread, "has_keyword_spread": False, "type_argument_count": len(_split(m[3][1:-1])) if m[3] else 0, "is_constructor": bool(m[1])}
        receiver = name.rpartition(".")[0] or None
        add("call", m.start(2), m.end(2), name, receiver=receiver, shape=shape)
    if language != "javascript":
        for m in re.finditer(rf"(?<=[\w)\]?]):\s*({_NAME}(?:\.{_NAME})*)(?=[\s<\[|&,;)={{])", code):
            if m[1] not in _KEYWORDS | {"string", "number", "boolean", "any", "unknown", "never", "object", "symbol", "bigint"} and m.start(1) not in taken:
                add("type_use", m.start(1), m.end(1), m[1])
    if language != "typescript":
        for m in re.finditer(rf"<([A-Z][\w$]*(?:\.{_NAME})*)(?=[\s/>])", code):
            if m.start(1) not in taken:
                add("read", m.start(1), m.end(1), m[1])
    for m in re.finditer(rf"(?<![\w$.])((?:{_NAME}\??\.)+{_NAME})(?!\s*(?:<[\w\s,.]*>)?\()(?=(\s*(?:[-+*/%&|^]|\*\*|<<|>>|\?\?|&&|\|\|)?=(?![=>]))?)", code):
        if m.start(1) not in taken:
            name = m[1].replace("?.", ".")
            add("write" if m[2] else "read", m.start(1), m.end(1), name, receiver=name.rpartition(".")[0])
    known = {r["written"] for r in out if r["kind"] == "import"} | {d["symbol"] for d in defined}
    for m in re.finditer(rf"(?<![\w$.])({_NAME})(?![\w$])(?!\s*[:(.])", code):
        declared = any(m.start() - s < 60 and code[s : m.start()].split()[-1:] in (["class"], ["function"], ["const"], ["let"], ["var"], ["interface"], ["type"], ["enum"]) for s in heads if s <= m.start())
        if m[1] in known and m.start() not in taken and not declared and code[: m.start()].rstrip()[-5:] not in ("const",):
            add("read", m.start(), m.end(), m[1])
    seen, unique = set(), []
    for r in out:
        key = (r["kind"], r["start"], r["end"])
        if key not in seen:
            seen.add(key)
            unique.append(r)
    return sorted(unique, key=lambda r: (r["start"], r["end"], r["kind"]))


def extract(data: bytes, language: str) -> tuple[list[dict], list[dict], bool]:
    """Definitions, references (spans in bytes) and the error flag."""
    text = data.decode("utf-8", "replace")
    defined = definitions(text, language)
    found = references(text, language, defined)
    if not text.isascii():  # characters to bytes, by one pass over the text
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        for row in [*defined, *found]:
            row["start"], row["end"] = at[row["start"]], at[row["end"]]
    return defined, found, False
