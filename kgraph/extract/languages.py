"""Extractors: a file's text to nodes and edges.  Rules are data; only scopes, which are sequential, are code."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from . import rules as r


@dataclass
class Found:
    """What a file yields; nodes are (name, type, line), edges (type, category, source, target)."""

    module: str
    nodes: list[tuple[str, str, int]] = field(default_factory=list)
    edges: list[tuple[str, str, str, str]] = field(default_factory=list)

    def node(self, name: str, kind: str, line: int) -> None:
        self.nodes.append((name, kind, line))

    def edge(self, kind: str, source: str, target: str, category: str = "structural") -> None:
        self.edges.append((kind, category, source, target))

    def import_once(self, source: str, target: str) -> None:
        if target.startswith(("/", ".")) and not any(e[0] == "imports" and e[3] == target for e in self.edges):
            self.edge("imports", source, target)


def _first(patterns: list[str], text: str) -> str | None:
    return next((m[1] for p in patterns if (m := re.match(p, text))), None)


def braces(line: str, strip: bool) -> tuple[int, int]:
    if strip:
        line = r.LITERALS.sub("", line)
    return line.count("{"), line.count("}")


def script(content: str, path: str, dialect: str) -> Found:
    """B1, B2: JavaScript and TypeScript.  Open functions are a stack of (name, depth); a function closes when the depth
    is back at where it began."""
    out = Found(posixpath.basename(path))
    out.node(out.module, "module", 1)
    depth, functions, class_depth = 0, [], None
    for number, raw in enumerate(content.split("\n"), 1):
        line = raw.strip()
        if dialect == "ts" and r.TYPE_IMPORT.match(line):
            line = raw = ""
        if dialect == "ts":
            for kind, pattern in r.TS_TYPES:
                if m := re.match(pattern, line):
                    out.node(m[1], kind, number)
        if m := re.match(r.CLASS[dialect], line):
            out.node(m[1], "class", number)
            class_depth = depth
        if name := _first(r.FUNCTIONS[dialect], line):
            out.node(name, "function", number)
            functions.append((name, depth))
        if class_depth is not None and depth > class_depth and (m := re.match(r.METHOD[dialect], line)) and m[1] not in r.NOT_METHODS:
            out.node(m[1], "method", number)
        scope = functions[-1][0] if functions else out.module
        if m := r.ROUTE.search(line):
            route = f"{m[1].upper()} {m[2]}"
            out.node(route, "route", number)
            out.edge("attaches", scope, route)
        elif m := r.MIDDLEWARE.search(line):
            out.edge("attaches", scope, m[1])
        for target in [*r.REQUIRE.findall(raw), *r.ES_IMPORT.findall(line)]:
            out.import_once(scope, target)
        if m := r.EXPORT_LIST.match(line):
            names = [k.strip().split(":")[0].strip() for k in m[1].split(",")]
        else:
            names = [m[1] for m in [r.EXPORT_ONE.match(line)] if m]
        names += [m[1] for m in (r.EXPORT_NAMED.match(line), re.match(r.ES_EXPORT[dialect], line)) if m]
        for name in filter(None, names):
            out.edge("exports", out.module, name)
        for literal in r.STRING_LITERAL.findall(raw):
            if table := next((m[1] for p in r.SQL_TABLE if (m := p.search(literal))), None):
                out.edge("queries_table", scope, table, "data_flow")
        opened, closed = braces(raw, strip=dialect == "js")
        depth += opened - closed
        while functions and depth <= functions[-1][1]:
            functions.pop()
        if class_depth is not None and depth <= class_depth:
            class_depth = None
    return out


def python(content: str, path: str) -> Found:
    """A definition deeper than its class is a method; decorators belong to the definition that follows them."""
    out = Found(posixpath.basename(path))
    out.node(out.module, "module", 1)
    decorators: list[str] = []
    class_indent: int | None = None
    for number, raw in enumerate(content.split("\n"), 1):
        line = raw.strip()
        indent = len(raw) - len(raw.lstrip())
        if m := r.PY_DECORATOR.match(line):
            decorators.append(m[1])
            continue
        named = r.PY_DEF.match(line) or r.PY_CLASS.match(line)
        if named:
            is_class = line.startswith("class")
            inside = class_indent is not None and indent > class_indent
            out.node(named[1], "class" if is_class else "method" if inside else "function", number)
            if is_class:
                class_indent = indent
            elif not inside:
                class_indent = None
            for d in decorators:
                out.edge("decorates", named[1], d)
            decorators = []
            continue
        if line and not line.startswith("#"):
            decorators = []
            if class_indent is not None and indent <= class_indent:
                class_indent = None
        if m := r.PY_IMPORT.match(line):
            out.edge("imports", out.module, m[1])
    return out


def markdown(content: str, path: str) -> Found:
    """Sections, commands, and references to files; each node and edge once."""
    out = Found(path)
    nodes: dict[tuple[str, str], int] = {}
    edges: dict[tuple[str, str, str], None] = {}
    if front := re.match(r"---\n(.*?)\n---", content, re.DOTALL):
        if m := re.search(r"^name:\s*(.+?)\s*$", front[1], re.MULTILINE):
            nodes[(m[1].strip("\"'"), "skill")] = 1
    section = path
    fence: list[str] | None = None
    for number, line in enumerate(content.split("\n"), 1):
        if line.lstrip().startswith("```"):
            for held in fence or []:
                call = r.NODE_CALL.search(held)
                if call:
                    edges[("triggers", section, call[1])] = None
                for target in r.FILE_PATH.findall(held):
                    if not call or target != call[1]:
                        edges[("references", section, target)] = None
            fence = [] if fence is None else None
        elif fence is not None:
            fence.append(line)
        elif m := r.HEADING.match(line):
            section = m[2].strip()
            nodes.setdefault((section, "doc_section"), number)
            for target in r.FILE_PATH.findall(section):
                edges[("describes", section, target)] = None
        else:
            for span in map(str.strip, r.CODE_SPAN.findall(line)):
                if r.SLASH_COMMAND.match(span):
                    nodes.setdefault((span, "command"), number)
                    edges[("triggers", section, span)] = None
                elif r.FILE_PATH.fullmatch(span):
                    edges[("references", section, span)] = None
            for target in r.DB_FILE.findall(line):
                edges[("references", section, target)] = None
    for (name, kind), number in nodes.items():
        out.node(name, kind, number)
    for kind, source, target in edges:
        out.edge(kind, source, target, "documentary")
    return out


def svelte(content: str, path: str) -> Found:
    """A component, what its script imports, its props, the events it sends, its slots."""
    out = Found(posixpath.basename(path).removesuffix(".svelte"))
    out.node(out.module, "component", 1)
    if m := r.SCRIPT.search(content):
        first = content.count("\n", 0, m.start(1)) + 1
        for k, raw in enumerate(m[1].split("\n")):
            line = raw.strip()
            if r.TYPE_IMPORT.match(line):
                continue
            if found := r.ES_IMPORT.match(line):
                out.import_once(out.module, found[1])
                continue
            props = [found[1]] if (found := r.PROP.match(line)) else []
            if found := r.RUNE_PROPS.match(line):
                names = [p.strip().split("=")[0].strip() for p in found[1].split(",")]
                props = [n for n in names if n and not n.startswith("...")]
            for name in props:
                out.node(name, "prop", first + k)
                out.edge("exports", out.module, name)
            if not props:
                for event in r.DISPATCH.findall(raw):
                    out.edge("dispatches", out.module, event, "data_flow")
    seen = set()
    for m in r.SLOT.finditer(content):
        name = m[1] or "default"
        if name not in seen:
            seen.add(name)
            out.node(name, "slot", content.count("\n", 0, m.start()) + 1)
    return out


def body_by_braces(content: str, line: int) -> str | None:
    """From a line to where its braces balance; the line alone if it opens none."""
    lines = content.split("\n")
    if not 1 <= line <= len(lines):
        return None
    depth, opened = 0, False
    for k in range(line - 1, len(lines)):
        up, down = braces(lines[k], strip=False)
        depth, opened = depth + up - down, opened or up > 0
        if opened and depth <= 0:
            return "\n".join(lines[line - 1 : k + 1])
    return lines[line - 1] if not opened else "\n".join(lines[line - 1 : line])


def body_by_indent(content: str, line: int) -> str | None:
    """From a line to the next that is indented no more; blank lines and comments at the end are left out."""
    lines = content.split("\n")
    if not 1 <= line <= len(lines):
        return None
    depth = lambda s: len(s) - len(s.lstrip())
    plain = lambda s: s.strip() and not s.strip().startswith("#")
    end = next((k for k in range(line, len(lines)) if plain(lines[k]) and depth(lines[k]) <= depth(lines[line - 1])), len(lines))
    while end > line and not plain(lines[end - 1]):
        end -= 1
    return "\n".join(lines[line - 1 : end])


def body_of(content: str, name: str) -> str | None:
    """Of the first declaration of that name."""
    word = re.escape(name)
    declared = re.compile(rf"^\s*(?:export\s+(?:default\s+)?)?(?:(?:async\s+)?function\s+{word}\b|class\s+{word}\b|(?:const|let|var)\s+{word}\s*=|(?:static\s+)?(?:async\s+)?{word}\s*\([^)]*\)\s*\{{)")
    at = next((k for k, text in enumerate(content.split("\n"), 1) if declared.match(text)), None)
    return body_by_braces(content, at) if at else None


def section_of(content: str, section: str, lines: tuple[int, int] | None = None) -> str | None:
    """Script, style or template of a markup file, or some of its lines."""
    if section == "template":
        found = re.sub(r"(?s)<(script|style)[^>]*>.*?</\1>", "", content).strip()
    else:
        m = re.search(rf"(?s)<{section}[^>]*>.*?</{section}>", content)
        found = m[0] if m else None
    if found and lines:
        found = "\n".join(found.split("\n")[lines[0] - 1 : lines[1]])
    return found


def svelte_labels(path: str, name: str) -> list[tuple[str, str, str, float, tuple[str, ...]]]:
    """Of a framework's route files, told by path and name; the body has no say."""
    file = posixpath.basename(path)
    if name == "load" and r.SVELTE_LOAD.search(file):
        return [("svelte-load", "data-access", "load function", 0.95, ("sveltekit",))]
    if name in r.HTTP_METHODS and file in ("+server.js", "+server.ts"):
        return [("svelte-server-endpoint", "route-handler", "server endpoint", 0.95, ("sveltekit", name.lower()))]
    return []


def detect(path: str, content: str, name: str, body: str | None, decorators: list[str] = ()) -> list[tuple[str, str, str, float, tuple[str, ...]]]:
    """(detector, category, term, confidence, descriptors) of a node."""
    out = svelte_labels(path, name)
    if not body:
        return out
    language = {"js": "js", "mjs": "js", "cjs": "js", "py": "py"}.get(path.rpartition(".")[2], "")
    out += [(k, c, t, f, d) for k, (lang, c, t, p, f, d) in r.DETECTORS.items() if lang == language and re.search(p, body, re.ASCII)]
    if language == "js":
        if m := re.search(r.THREE_ARGUMENTS, body, re.ASCII):
            named = m.groups() == ("req", "res", "next")
            out.append(("express-middleware", "middleware", "middleware", 0.95 if named else 0.7, ("express", "request") if named else ("3-arity",)))
        attached = rf"(?<!\w)app\.(get|post|put|patch|delete|all|use)\s*\(\s*['\"`][^'\"`]+['\"`]\s*,\s*{re.escape(name)}(?!\w)"
        if re.search(r.TWO_ARGUMENTS, body) and re.search(attached, content):
            out.append(("express-route-handler", "route-handler", "route handler", 0.95, ("express",)))
    if language == "py" and any(d.rpartition(".")[2] in ("route", "get", "post", "put", "patch", "delete") for d in decorators):
        out.append(("flask-route", "route-handler", "route handler", 0.95, ("flask",)))
    return out


# ---- test pairs (B17, R4) --------------------------------------------------------------------------------------------


def is_test(path: str) -> bool:
    name = posixpath.basename(path)
    if path.endswith(".py"):
        return bool(re.search(r"^test_.+\.py$|.+_test\.py$", name) or re.search(r"(^|/)(test|tests)/", path))
    return bool(re.search(r"\.(test|spec)\.([mc]?[jt]s|tsx|svelte)$", name) or re.search(r"(^|/)(test|tests|__tests__|spec)/", path))


def test_candidates(path: str) -> list[str]:
    """Where a source's test may be, likeliest first."""
    folder, name = posixpath.split(path)
    stem, ext = posixpath.splitext(name)
    parent = posixpath.basename(folder)
    join = posixpath.join
    if ext == ".py":
        places = [join(folder, f"test_{stem}.py"), join(folder, f"{stem}_test.py")]
        places += [join(top, f"test_{stem}.py") for top in ("test", "tests")] + [join(top, folder, f"test_{stem}.py") for top in ("test", "tests")]
        return places + ([join("tests", path.removeprefix("src/")), join("tests", posixpath.dirname(path.removeprefix("src/")), f"test_{stem}.py")] if path.startswith("src/") else [])
    kinds = [ext] if ext != ".svelte" else [".js", ".ts", ".svelte", ".svelte.js"]
    out = []
    for kind in kinds:
        out += [join(folder, f"{stem}.{t}{kind}") for t in ("test", "spec")]
        out += [join(folder, "__tests__", f"{stem}.{t}{kind}") for t in ("test", "spec")]
    for top in ("test", "tests"):
        out.append(join(top, path))
    out += [join(top, f"{stem}.test{ext}") for top in ("test", "tests")]
    return out + ([join(top, f"{parent}-{stem}.test{ext}") for top in ("test", "tests")] if parent else [])


def annotations(content: str) -> list[str]:
    """Sources that a test names in its first 20 lines."""
    return re.findall(r"(?://|#)[ \t]*@tests[ \t]+(\S+)", "\n".join(content.split("\n")[:20]))


# ---- registry (A3, R1, R2) -------------------------------------------------------------------------------------------

Extractor = Callable[[str, str], Found]


class Registry:
    """Extension -> extractor, and detectors that are checked when they are added."""

    def __init__(self) -> None:
        self.extractors: dict[str, Extractor] = {}
        self.detectors: dict[str, tuple[str, str, Callable]] = {}

    def register(self, extensions: list[str], extractor: Extractor) -> None:
        if not callable(extractor):
            raise ValueError("extractor must be a function")
        if not extensions or not all(e.startswith(".") for e in extensions):
            raise ValueError("extensions must begin with a dot")
        for e in extensions:
            self.extractors[e] = extractor

    def register_detector(self, id: str, category: str, default_term: str, function: Callable) -> None:
        from ..schemas import LABEL_CATEGORIES

        if not id or not isinstance(id, str):
            raise ValueError("detector has an invalid id")
        if id in self.detectors:
            raise ValueError(f"detector {id} is registered already")
        if category not in LABEL_CATEGORIES:
            raise ValueError(f"detector {id} has the unknown category {category}")
        if not default_term:
            raise ValueError(f"detector {id} has no default term")
        if not callable(function):
            raise ValueError(f"detector {id} is no function")
        self.detectors[id] = (category, default_term, function)

    def extract(self, content: str, path: str) -> Found:
        """Nothing for an unknown extension."""
        extractor = self.extractors.get(posixpath.splitext(path)[1])
        return extractor(content, path) if extractor else Found(posixpath.basename(path))

    def labels(self, node: dict) -> list[tuple[str, str, str, float, tuple]]:
        """Results of all detectors; those that throw, or answer in another shape, are left out."""
        out = []
        for id, (category, term, function) in self.detectors.items():
            try:
                found = function(node)
                if found:
                    out.append((id, category, found.get("term") or term, min(1.0, max(0.0, float(found["confidence"]))), tuple(found.get("descriptors", ()))))
            except Exception:  # noqa: BLE001  a plug-in's failure is its own
                continue
        return out


def default_registry() -> Registry:
    registry = Registry()
    registry.register([".js", ".mjs", ".cjs"], lambda c, p: script(c, p, "js"))
    registry.register([".ts", ".tsx"], lambda c, p: script(c, p, "ts"))
    registry.register([".py"], python)
    registry.register([".md"], markdown)
    registry.register([".svelte"], svelte)
    return registry
