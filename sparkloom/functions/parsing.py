"""A declaration scanner for source files: symbols, calls, imports and references.

Comments and strings are blanked out in place (so offsets hold), declarations are
found by one pattern a kind and language, and a declaration's extent is its
balanced braces (or, for Python, its syntax tree's).  It is no full grammar: it
finds declarations, not expressions.  Pure Python; operators run it a file at a
time inside Arrow batches.
"""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass, field

_W = r"[A-Za-z_]\w*"


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    at: int
    visibility: str = "Public"
    parent: str | None = None
    signature: str | None = None
    doc: str | None = None
    annotations: list[tuple[str, list[str], int]] = field(default_factory=list)


def _decl(kind: str, pattern: str) -> tuple[str, re.Pattern]:
    return kind, re.compile(pattern, re.M)


_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|virtual|partial|readonly|default|synchronized|native|data|inner|suspend|inline|enum|annotation|companion|operator|const|lateinit|export|declare)\s+)*)"
_LINE = r"^[ \t]*"
#: Declarations by language; name is the symbol's, mods its modifiers, type and args a method's.
DECLARATIONS = {
    "rust": [
        _decl("Function", rf"{_LINE}(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>{_W})"),
        _decl("Struct", rf"{_LINE}(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)struct\s+(?P<name>{_W})"),
        _decl("Enum", rf"{_LINE}(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)enum\s+(?P<name>{_W})"),
        _decl("Trait", rf"{_LINE}(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:unsafe\s+)?trait\s+(?P<name>{_W})"),
        _decl("Module", rf"{_LINE}(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)mod\s+(?P<name>{_W})"),
    ],
    "typescript": [
        _decl("Function", rf"{_LINE}{_MODS}(?:default\s+)?function\s*\*?\s*(?P<name>{_W})"),
        _decl("Class", rf"{_LINE}{_MODS}(?:default\s+)?class\s+(?P<name>{_W})"),
    ],
    "java": [
        _decl("Class", rf"{_LINE}{_MODS}class\s+(?P<name>{_W})"),
        _decl("Interface", rf"{_LINE}{_MODS}@?interface\s+(?P<name>{_W})"),
        _decl("Enum", rf"{_LINE}{_MODS}enum\s+(?P<name>{_W})"),
        _decl("Method", rf"{_LINE}{_MODS}(?:<[^>{{;]*>\s+)?(?P<type>(?!return\b|new\b|else\b|throw\b|package\b|import\b)[\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*)\s+(?P<name>{_W})\s*\((?P<args>[^)]*)\)[^;{{}}=]*[{{;]"),
        _decl("Constructor", rf"{_LINE}{_MODS}(?P<name>{_W})\s*\((?P<args>[^)]*)\)\s*(?:throws\s+[\w., ]+)?\{{"),
        _decl("Field", rf"{_LINE}{_MODS}(?P<type>(?!return\b|package\b|import\b|new\b|throw\b)[\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*)\s+(?P<name>{_W})\s*(?:=[^;]*)?;"),
    ],
    "go": [
        _decl("Method", rf"^func\s+\((?P<recv>[^)]*)\)\s*(?P<name>{_W})"),
        _decl("Function", rf"^func\s+(?P<name>{_W})"),
        _decl("Struct", rf"{_LINE}(?:type\s+)?(?P<name>{_W})\s+struct\b"),
        _decl("Interface", rf"{_LINE}(?:type\s+)?(?P<name>{_W})\s+interface\b"),
    ],
    "kotlin": [
        _decl("Interface", rf"{_LINE}{_MODS}interface\s+(?P<name>{_W})"),
        _decl("Class", rf"{_LINE}{_MODS}(?:class|object)\s+(?P<name>{_W})"),
        _decl("Function", rf"{_LINE}{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<name>{_W})"),
        _decl("Property", rf"{_LINE}{_MODS}va[lr]\s+(?P<name>{_W})"),
    ],
    "csharp": [
        _decl("Module", rf"{_LINE}namespace\s+(?P<name>[\w.]+)"),
        _decl("Class", rf"{_LINE}{_MODS}(?:class|record)\s+(?P<name>{_W})"),
        _decl("Interface", rf"{_LINE}{_MODS}interface\s+(?P<name>{_W})"),
        _decl("Struct", rf"{_LINE}{_MODS}struct\s+(?P<name>{_W})"),
        _decl("Enum", rf"{_LINE}{_MODS}enum\s+(?P<name>{_W})"),
        _decl("Method", rf"{_LINE}{_MODS}(?P<type>(?!return\b|new\b|else\b|throw\b|using\b|await\b)[\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*\??)\s+(?P<name>{_W})\s*\((?P<args>[^)]*)\)[^;{{}}]*[{{;]"),
        _decl("Property", rf"{_LINE}{_MODS}(?P<type>(?!return\b|namespace\b|class\b|struct\b|enum\b|interface\b|record\b)[\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*\??)\s+(?P<name>{_W})\s*\{{\s*(?:get|set|init)"),
    ],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
#: Imports by language.
IMPORTS = {
    "rust": re.compile(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", re.M),
    "typescript": re.compile(r"""^[ \t]*import\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]""", re.M),
    "java": re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;", re.M),
    "kotlin": re.compile(r"^[ \t]*import\s+([\w.*]+)", re.M),
    "csharp": re.compile(r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;", re.M),
}
IMPORTS["javascript"] = IMPORTS["typescript"]
_CALL = re.compile(rf"(?<![\w]){_W}(?=!?\s*\()")
_NOT_CALLS = set("if for while switch match return catch fn func function class def new sizeof typeof when using lock await async throw else elif in not and or assert with super this".split())
_KEYWORDS = set("if for while switch match return catch else when lock using throw".split())
_CLASSES = {"Class", "Interface", "Enum", "Struct", "Trait", "Impl"}


def blanked(text: str, language: str) -> str:
    """text with comments and the insides of strings as spaces; line ends stay."""
    line = "#" if language == "python" else "//"
    quotes = "\"'`" if language in ("typescript", "javascript", "go") else '"' if language == "rust" else "\"'"
    out, k, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for i in range(a, min(b, n)):
            if out[i] != "\n":
                out[i] = " "

    while k < n:
        if text.startswith(line, k):
            end = text.find("\n", k)
            end = n if end < 0 else end
            blank(k, end)
            k = end
        elif language != "python" and text.startswith("/*", k):
            end = text.find("*/", k + 2)
            end = n if end < 0 else end + 2
            blank(k, end)
            k = end
        elif text[k] in quotes:
            q = text[k] * 3 if text.startswith(text[k] * 3, k) and language in ("kotlin", "python", "csharp") else text[k]
            end = k + len(q)
            while end < n and not text.startswith(q, end) and (len(q) == 3 or q == "`" or text[end] != "\n"):
                end += 2 if text[end] == "\\" else 1
            blank(k + len(q), end)
            k = end + len(q)
        else:
            k += 1
    return "".join(out)


def _extent(code: str, at: int) -> int:
    """Where the declaration at an offset ends: after its balanced braces, or at the line's end or semicolon without any."""
    depth, k = 0, at
    while k < len(code):
        c = code[k]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return k + (depth == 0)
        elif not depth and (c == ";" or (c == "\n" and re.match(r"\s*(?:$|[@#\w}])", code[k + 1 : k + 40]) and not re.search(r"[,({\[=:]\s*$|\b(?:where|implements|extends|throws)\s*$", code[at:k]) and not re.match(r"\s*(?:where|implements|extends|throws)\b|\s*\{", code[k + 1 : k + 40]))):
            return k
        k += 1
    return len(code)


def _visibility(language: str, mods: str, name: str) -> str:
    """Each language's own default where no modifier says more."""
    if language == "rust":
        return "Private" if "pub" not in mods else "Crate" if "crate" in mods else "Super" if "super" in mods else "Public"
    if language == "go":
        return "Public" if name[:1].isupper() else "Private"
    said = {"public": "Public", "private": "Private", "internal": "Crate", "protected": "Super"}
    for word, what in said.items():
        if word in mods.split() and not (word == "internal" and language == "java"):
            return what
    return "Private" if language in ("java", "csharp") else "Public"


def _arguments(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


_ANNOTATION = {
    "rust": re.compile(r"#\[\s*([\w:]+)\s*(?:\(([^\]]*)\))?[^\]]*\]"),
    "csharp": re.compile(r"\[\s*([\w.]+)\s*(?:\(([^\]]*)\))?\s*\]"),
}
_AT = re.compile(r"@([\w.:]+)\s*(?:\(([^()]*(?:\([^()]*\)[^()]*)*)\))?")


def _before(lines: list[str], k: int, language: str) -> tuple[list[tuple[str, list[str], int]], str | None]:
    """Annotations and the doc comment on the lines above line k (from 0)."""
    annotations, doc, inside = [], [], False
    pattern = _ANNOTATION.get(language, _AT)
    while k > 0:
        s = lines[k - 1].strip()
        if inside or s.endswith("*/"):
            inside = not s.startswith("/*")
            doc.append(re.sub(r"^/?\*+/?|\*+/$", "", s).strip())
        elif s.startswith(("///", "//")) and language in ("rust", "go", "csharp", "kotlin", "java"):
            doc.append(s.lstrip("/").strip())
        elif s and pattern.match(s):
            annotations += [(m[1], _arguments(m[2]), k) for m in pattern.finditer(s)]
        else:
            break
        k -= 1
    return annotations[::-1], "\n".join(x for x in doc[::-1] if x) or None


def _python(text: str) -> tuple[list[Symbol], list[tuple[str, str, int]], list[tuple[str, int]]]:
    try:
        root = ast.parse(text)
    except SyntaxError:
        return [], [], []
    symbols, calls, imports = [], [], []
    starts = [0]
    for x in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(x))

    def walk(node: ast.AST, parent: str | None, owner: str | None) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "Class" if isinstance(c, ast.ClassDef) else "Function"
                at = text.find(c.name, starts[c.lineno - 1])
                symbols.append(Symbol(c.name, kind, c.lineno, c.end_lineno or c.lineno, at, "Public", parent, None, ast.get_docstring(c)))
                walk(c, c.name if kind == "Class" else parent, owner if kind == "Class" else c.name)
                continue
            if isinstance(c, ast.Call) and owner:
                f = c.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    calls.append((owner, name, c.lineno))
            if isinstance(c, ast.ImportFrom) and c.module:
                imports.append((c.module, c.lineno))
            walk(c, parent, owner)

    walk(root, None, None)
    return symbols, calls, imports


def _go_imports(text: str) -> list[tuple[str, int]]:
    found = []
    for m in re.finditer(r'^import\s+(?:\w+\s+)?"([^"]+)"|^import\s*\(([^)]*)\)', text, re.M):
        if m[1]:
            found.append((m[1], text.count("\n", 0, m.start()) + 1))
        else:
            found += [(x[1], text.count("\n", 0, m.start(2) + x.start()) + 1) for x in re.finditer(r'"([^"]+)"', m[2])]
    return found


def parsed(text: str, language: str) -> tuple[list[Symbol], list[tuple[str, str, int]], list[tuple[str, int]]]:
    """Symbols; calls (caller's name, called name, line); imports (name, line)."""
    if language == "python":
        return _python(text)
    if language not in DECLARATIONS:
        return [], [], []
    code = blanked(text, language)
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    raw = text.split("\n")
    spans: list[tuple[int, int, Symbol]] = []
    if language == "rust":
        for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b[^{;]*?(?:for\s+)?([A-Za-z_]\w*)(?:<[^{]*>)?\s*(?:where[^{]*)?\{", code, re.M):
            spans.append((m.start(), _extent(code, m.end() - 1), Symbol(m[1], "Impl", line(m.start()), 0, m.start(1))))
    taken: set[int] = set()
    for kind, pattern in DECLARATIONS[language]:
        for m in pattern.finditer(code):
            if m.start("name") in taken or m["name"] in _KEYWORDS:
                continue
            taken.add(m.start("name"))
            groups = m.groupdict()
            first = line(m.start("name"))
            head = m.start() + len(m[0]) - len(m[0].lstrip())
            end = _extent(code, m.start("name"))
            annotations, doc = _before(raw, line(head) - 1, language)
            inline = [(x[1], _arguments(x[2]), first) for x in _ANNOTATION.get(language, _AT).finditer(raw[first - 1][: max(0, raw[first - 1].find(m["name"]))])]
            s = Symbol(m["name"], kind, line(head), line(max(end - 1, head)), m.start("name"), _visibility(language, groups.get("mods") or "", m["name"]), None, None, doc, annotations + inline)
            if kind == "Method" and groups.get("type"):
                s.signature = f"{groups['type']} {m['name']}({' '.join((groups.get('args') or '').split())})"
            if kind == "Method" and groups.get("recv"):
                s.parent = re.sub(r"^.*?\*?\s*(\w+)\s*$", r"\1", groups["recv"])
            spans.append((head, end, s))
    spans.sort(key=lambda x: (x[0], -x[1]))
    out, calls, open_ = [], [], []
    for a, b, s in spans:
        while open_ and open_[-1][1] <= a:
            open_.pop()
        holder = next((x for x in reversed(open_)), None)
        if holder and s.kind in ("Constructor", "Field") and holder[2].kind not in _CLASSES or not holder and s.kind in ("Constructor", "Field"):
            continue
        if holder and holder[2].kind in ("Function", "Method", "Constructor") and s.kind in ("Method", "Function", "Property", "Field"):
            continue  # inside a body
        if holder and holder[2].kind in _CLASSES:
            s.parent = s.parent or holder[2].name
            if language == "rust" and s.kind == "Function":
                s.kind = "Method"
        if s.kind == "Constructor":
            s.kind = "Function"
        open_.append((a, b, s))
        if s.kind != "Impl":
            out.append((a, b, s))
    bodies = [(a, b, s) for a, b, s in out if s.kind in ("Function", "Method")]
    for a, b, s in bodies:
        brace = code.find("{", s.at, b)
        if brace < 0:
            continue
        inner = [(x, y) for x, y, t in bodies if x > a and y <= b and t is not s]
        for m in _CALL.finditer(code, brace, b):
            if m[0] not in _NOT_CALLS and not any(x <= m.start() < y for x, y in inner):
                calls.append((s.name, m[0], line(m.start())))
    imports = _go_imports(text) if language == "go" else [(m[1].strip(), line(m.start(1))) for m in IMPORTS[language].finditer(text if language in ("typescript", "javascript") else code)]
    return [s for *_, s in out], calls, imports


def references(text: str, language: str, symbols: list[Symbol]) -> list[tuple[str, int, int, str, str]]:
    """(name, line, column, kind, line's text) of the identifiers that name a symbol of the file, but for the place of its definition."""
    names, defined = {s.name for s in symbols}, {s.at for s in symbols}
    code, raw = blanked(text, language), text.split("\n")
    found = []
    for m in re.finditer(_W, code):
        if m[0] in names and m.start() not in defined:
            first = code.count("\n", 0, m.start())
            column = m.start() - (code.rfind("\n", 0, m.start()) + 1)
            before, after = code[max(0, m.start() - 40) : m.start()].rstrip(), code[m.end() : m.end() + 40].lstrip()
            kind = "import" if re.match(r"\s*(?:use|import|from|using|#include)\b", raw[first]) else "call" if after.startswith("(") else "field_access" if before.endswith(".") else "type_annotation" if before.endswith((":", "->", "<")) else "assignment" if re.match(r"=(?!=)", after) else "reference"
            found.append((m[0], first + 1, column, kind, raw[first].strip()))
    return found
