"""The chunk table's schema, and the parsers of whole files that can only be written as Python: mapInArrow over (path,
text), one output row a chunk. A file that doesn't parse yields no chunk and an entry in `error`."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "chunk_id string, content string, type string, file_path string, fqn string, start_line int, end_line int, imports array<string>,"
    " annotations array<string>, class_context string, package_context string, api_calls array<string>, mvc map<string,string>, metadata_json string, error string"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in SCHEMA.split(", "))])
TYPES = ("METHOD", "CLASS", "JSP_FRAGMENT", "CONFIG_SECTION", "IMPORT_BLOCK", "FIELD")
WINDOW, OVERLAP = 100, 25


@dataclass
class Chunk:
    content: str
    type: str
    file_path: str
    fqn: str | None = None
    start_line: int = 1
    end_line: int = 1
    imports: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)
    class_context: str | None = None
    package_context: str | None = None
    api_calls: list[str] = field(default_factory=list)
    mvc: dict[str, str] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    def row(self, n: int) -> dict:
        """The id depends on the chunk alone: path, kind, place and number."""
        own = sha256(f"{self.file_path}\0{self.type}\0{self.start_line}\0{n}".encode()).hexdigest()
        return {k: list(v.items()) if k == "mvc" else v for k, v in vars(self).items() if k != "metadata"} | {"chunk_id": own, "metadata_json": json.dumps(self.metadata, sort_keys=True), "error": None}


def chunks(files: DataFrame, parse: Callable[[str, str], list[Chunk]]) -> DataFrame:
    """files: (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += [c.row(n) for n, c in enumerate(parse(path, text or ""))]
                except Exception as e:  # one bad file must not end the job; it is reported in its row
                    rows.append({"file_path": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def searchable(chunks: DataFrame) -> Column:
    """What a chunk is found and embedded by: package, imports, class, annotations, then its content."""
    none = F.array().cast("array<string>")
    package = F.when(F.col("package_context").isNotNull(), F.array(F.concat(F.lit("package "), "package_context", F.lit(";")))).otherwise(none)
    head = F.concat(package, F.transform(F.coalesce("imports", none), lambda i: F.concat(F.lit("import "), i, F.lit(";"))))
    context = F.when(F.coalesce("class_context", F.lit("")) != "", F.array("class_context")).otherwise(none)
    return F.array_join(F.concat(head, F.when(F.size(head) > 0, F.array(F.lit(""))).otherwise(none), context, F.coalesce("annotations", none), F.array("content")), "\n")


# --- XML configuration -------------------------------------------------------------------------------------------------


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].rpartition(":")[2]


def _text(e: ET.Element, name: str) -> str:
    found = next((x for x in e.iter() if x is not e and _local(x) == name), None)
    return "".join(found.itertext()).strip() if found is not None else ""


# For each element its kind, and where each mapping entry comes from (a child's text, or an attribute).
WEB = {
    "servlet": ("servlet", {"servletName": "servlet-name", "servletClass": "servlet-class"}),
    "servlet-mapping": ("servlet_mapping", {"servletName": "servlet-name", "urlPattern": "url-pattern"}),
    "filter": ("filter", {"filterName": "filter-name", "filterClass": "filter-class"}),
    "filter-mapping": ("filter_mapping", {"filterName": "filter-name", "urlPattern": "url-pattern"}),
}
STRUTS = {
    "action": ("action", {"actionPath": "path", "actionClass": "type", "formBean": "name", "inputPage": "input"}, ("path", "type", "name", "scope")),
    "form-bean": ("form_bean", {"formBeanName": "name", "formBeanClass": "type"}, ("name", "type")),
    "forward": ("forward", {"forwardName": "name", "forwardPath": "path"}, ("name", "path")),
}


def parse_config(path: str, text: str) -> list[Chunk]:
    """Sections of web.xml, struts-config.xml and tiles-defs.xml; any other XML file is one chunk."""
    name = path.rpartition("/")[2].lower()
    root = ET.fromstring(text)
    out: list[Chunk] = []
    searched: dict[str, int] = {}

    def section(e: ET.Element, kind: str, mvc: dict[str, str], metadata: dict) -> None:
        tag = _local(e)
        start = re.compile(rf"<(?:\w+:)?{re.escape(tag)}[\s/>]").search(text, searched.get(tag, 0))
        at = start.start() if start else 0
        searched[tag] = at + 1
        close = re.compile(rf"</(?:\w+:)?{re.escape(tag)}\s*>").search(text, at)
        first = text.count("\n", 0, at) + 1
        e.tail = None
        content = ET.tostring(e, encoding="unicode")
        last = text.count("\n", 0, close.end()) + 1 if close and list(e) else first + content.count("\n")
        out.append(Chunk(content, "CONFIG_SECTION", path, f"{name}#{kind}", first, last, mvc={k: v for k, v in mvc.items() if v}, metadata={"configType": kind} | metadata))

    if name == "web.xml":
        for tag, (kind, fields) in WEB.items():
            for e in (x for x in root.iter() if _local(x) == tag):
                values = {k: _text(e, child) for k, child in fields.items()}
                initial = {_text(p, "param-name"): _text(p, "param-value") for p in e.iter() if _local(p) == "init-param"}
                section(e, kind, values, values | ({"initParams": initial} if initial else {}))
    elif name == "struts-config.xml":
        for tag, (kind, fields, kept) in STRUTS.items():
            for e in (x for x in root.iter() if _local(x) == tag):
                metadata = {k: e.get(k, "") for k in kept}
                forwards = [{"name": f.get("name", ""), "path": f.get("path", "")} for f in e.iter() if f is not e and _local(f) == "forward"]
                section(e, kind, {k: e.get(a, "") for k, a in fields.items()}, metadata | ({"forwards": forwards} if forwards else {}))
    elif name == "tiles-defs.xml":
        for e in (x for x in root.iter() if _local(x) == "definition"):
            puts = {p.get("name", ""): p.get("value", "") for p in e.iter() if _local(p) == "put"}
            mvc = {"tileName": e.get("name", ""), "template": e.get("path") or e.get("template") or "", "extends": e.get("extends", "")}
            section(e, "tile_definition", mvc, {"name": e.get("name", "")} | ({"attributes": puts} if puts else {}))
    else:
        body = text.rstrip("\n")
        out.append(Chunk(text, "CONFIG_SECTION", path, name, 1, body.count("\n") + 1, metadata={"configType": "generic_xml", "rootElement": _local(root)}))
    return out


# --- Java --------------------------------------------------------------------------------------------------------------

_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_TYPE = re.compile(r"((?:@[\w.]+(?:\s*\([^)]*\))?\s*|\b(?:public|protected|private|static|final|abstract|sealed|strictfp)\s+)*)\b(class|interface)\s+(\w+)([^{;]*)\{")
_METHOD = re.compile(r"((?:@[\w.]+(?:\s*\([^)]*\))?\s*|\b(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*)(?:<[^>]+>\s*)?([\w.$]+(?:<[^;{}()]*>)?(?:\[\])*)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?([{;])")
_FIELD = re.compile(r"((?:@[\w.]+(?:\s*\([^)]*\))?\s*|\b(?:public|protected|private|static|final|transient|volatile)\s+)*)([\w.$]+(?:<[^;{}()]*>)?(?:\[\])*)\s+(\w+)\s*(?:=[^;]*|,[^;]*)?;")
_WORDS = {"return", "throw", "new", "else", "case", "import", "package", "goto", "assert", "if", "while", "for", "switch", "catch", "do", "try", "synchronized"}


_MODIFIERS = frozenset("public protected private static final abstract synchronized native default strictfp transient volatile".split())


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _masked(text: str) -> str:
    """The text with comments and literals blanked, same length and lines. So are annotations of parameters, and brackets
    inside those of members: no parenthesis of theirs is taken for another's."""
    masked = _HIDDEN.sub(lambda m: _blank(m[0]), text)
    out, depth, at = [], 0, 0
    for m in re.finditer(r"@(?!interface\b)[\w.]+(\s*\()?|[()]", masked):
        if m.start() < at:
            continue
        if m[0][0] != "@":
            depth += 1 if m[0] == "(" else -1
            continue
        end = m.end()
        if m[1]:
            inside = 1
            while inside and end < len(masked):
                inside += (masked[end] == "(") - (masked[end] == ")")
                end += 1
        if depth:
            out += [masked[at : m.start()], _blank(masked[m.start() : end])]
            at = end
        elif m[1]:
            out += [masked[at : m.end()], re.sub(r"[^\w\s.]", " ", masked[m.end() : end - 1])]
            at = end - 1
            depth += 1  # its own closing parenthesis comes next
    return "".join([*out, masked[at:]])


def _closing(masked: str, at: int) -> int:
    depth = 0
    for i in range(at, len(masked)):
        depth += (masked[i] == "{") - (masked[i] == "}")
        if not depth:
            return i
    raise ValueError("a brace is not closed")


def _annotations(text: str, masked: str) -> list[str]:
    """The annotations of a piece of the text, found in the same piece of what is masked."""
    return [text[m.start() : m.end()].strip() for m in re.finditer(r"@[\w.]+(?:\s*\([^)]*\))?", masked)]


def complexity(masked: str) -> int:
    """One, and one for each if, while (but not do-while), classic for and switch entry."""
    loops = len(re.findall(r"\bwhile\s*\(", masked)) - len(re.findall(r"\}\s*while\s*\([^{}]*?\)\s*;", masked))
    entries = len(re.findall(r"\bcase\b[^:]*?(?::|->)|\bdefault\s*(?::|->)", masked))
    return 1 + len(re.findall(r"\bif\s*\(", masked)) + loops + len(re.findall(r"\bfor\s*\([^;{}]*;", masked)) + entries


def api_calls(masked: str) -> list[str]:
    """Called names with their scopes, in order of occurrence; control words and constructors are no calls."""
    return [m[1].lstrip(".") for m in re.finditer(r"((?<![\w.])(?:\w+\.)*\w+|(?<=\))\.\w+)\s*\(", masked) if m[1].split(".")[0] not in _WORDS and not re.search(r"\bnew\s+\Z", masked[max(0, m.start() - 12) : m.start()])]


def windows(first: int, last: int, size: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Line windows over first..last: the first one that reaches the end is the last."""
    out, at = [], first
    while True:
        out.append((at, min(at + size - 1, last)))
        if out[-1][1] == last:
            return out
        at += size - overlap


def parse_java(path: str, text: str) -> list[Chunk]:
    """Classes and interfaces, then their methods (windows of WINDOW lines where longer) and fields; nested ones under the
    innermost class."""
    masked = _masked(text)
    if masked.count("{") != masked.count("}"):
        raise ValueError("braces do not match")
    package = (re.search(r"\bpackage\s+([\w.]+)\s*;", masked) or ["", ""])[1]
    imports = [m[1].removesuffix(".*") for m in re.finditer(r"\bimport\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", masked)]
    source = text.split("\n")
    line = lambda i: text.count("\n", 0, i) + 1
    out: list[Chunk] = []

    def of_class(m: re.Match) -> None:
        name, head, opened = m[3], m[4], m.end() - 1
        closed = _closing(masked, opened)
        body = list(masked[opened + 1 : closed])
        inner = []
        for n in _TYPE.finditer(masked, opened + 1, closed):
            if not inner or n.start() > inner[-1][1]:
                inner.append((n.start(), _closing(masked, n.end() - 1), n))
        for a, b, _ in inner:
            body[a - opened - 1 : b - opened] = [c if c == "\n" else " " for c in body[a - opened - 1 : b - opened]]
        own = "".join(body)
        fqn = f"{package}.{name}" if package else name
        extends = re.search(r"\bextends\s+([\w.]+)", head)
        faces = re.search(r"\bimplements\s+([^{]+)", head)
        context = f"{m[2]} {name}" + (f" extends {extends[1]}" if extends else "") + (f" implements {', '.join(x.strip() for x in faces[1].split(','))}" if faces else "")
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        methods, flat = [], list(own)
        for f in _METHOD.finditer(own):
            if f[2] in _WORDS or f[2] in _MODIFIERS or own.count("{", 0, f.start()) != own.count("}", 0, f.start()):
                continue  # a constructor has no type
            end = _closing(own, f.end() - 1) if f[5] == "{" else f.end() - 1
            methods.append((f, end))
            flat[f.start() : end + 1] = [c if c == "\n" else " " for c in flat[f.start() : end + 1]]
        flat = "".join(flat)
        level = lambda i: all(flat.count(a, 0, i) == flat.count(b, 0, i) for a, b in ("{}", "()"))
        fields = [f for f in _FIELD.finditer(flat) if f[2] not in _WORDS and f[2] not in _MODIFIERS and level(f.start(2))]
        shared = {"imports": imports, "package_context": package}
        annotated = slice(m.start(), m.start() + len(m[1]))
        out.append(Chunk("\n".join(source[line(start) - 1 : line(closed)]), "CLASS", path, fqn, line(start), line(closed), annotations=_annotations(text[annotated], masked[annotated]), metadata={"isInterface": m[2] == "interface", "isAbstract": "abstract" in m[1].split(), "methodCount": len(methods), "fieldCount": len(fields)}, **shared))
        for f, end in methods:
            a, b = opened + 1 + f.start(), opened + 1 + end
            a += len(f[0]) - len(f[0].lstrip())
            before = slice(opened + 1 + f.start(), opened + 1 + f.start() + len(f[1]))
            marks, words = _annotations(text[before], masked[before]), f[1].split()
            mvc: dict[str, str] = {}
            for mark in marks:
                if "@Action" in mark or "@RequestMapping" in mark:
                    mvc["actionPath"] = mark[mark.index('"') + 1 : mark.rindex('"')] if mark.count('"') > 1 else mark
            if f[3].startswith("execute") or f[3].endswith("Action"):
                mvc["actionMethod"] = f[3]
            code = masked[opened + 1 + f.end() : b]
            metadata = {"parameterCount": len([p for p in re.sub(r"<[^>]*>", "", f[4]).split(",") if p.strip()]), "isStatic": "static" in words, "isPublic": "public" in words, "isPrivate": "private" in words, "returnType": f[2], "complexity": complexity(code)}
            spans = windows(line(a), line(b))
            for i, (first, last) in enumerate(spans):
                more = {"windowIndex": i, "isPartial": True, "totalWindows": len(spans)} if len(spans) > 1 else {}
                out.append(Chunk("\n".join(source[first - 1 : last]), "METHOD", path, f"{fqn}.{f[3]}", first, last, annotations=marks, class_context=context, api_calls=api_calls(code), mvc=mvc, metadata=metadata | more, **shared))
        for f in fields:
            a, b = opened + 1 + f.start() + len(f[0]) - len(f[0].lstrip()), opened + 1 + f.end() - 1
            before, words = slice(opened + 1 + f.start(), opened + 1 + f.start() + len(f[1])), f[1].split()
            out.append(Chunk("\n".join(source[line(a) - 1 : line(b)]), "FIELD", path, f"{fqn}.{f[3]}", line(a), line(b), annotations=_annotations(text[before], masked[before]), class_context=context, metadata={"type": f[2], "isStatic": "static" in words, "isFinal": "final" in words, "isPrivate": "private" in words, "isPublic": "public" in words}, **shared))
        for *_, n in inner:
            of_class(n)

    at = 0
    while m := _TYPE.search(masked, at):
        of_class(m)
        at = _closing(masked, m.end() - 1) + 1
    return out


# --- JSP ---------------------------------------------------------------------------------------------------------------

_JSP = re.compile(r"<%--.*?--%>|<%@(.*?)%>|<%=(.*?)%>|<%!?(.*?)%>", re.S)
_TAG = re.compile(r"<(html|logic|bean|tiles|jsp):(\w+)\b([^>]*?)/?>", re.S)
_FORM = re.compile(r"<((?:html:)?form)\b([^>]*)>(.*?)</\1\s*>", re.S | re.I)


def attribute(text: str, name: str) -> str:
    return (re.search(rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", text) or ["", ""])[1]


def dotted_calls(code: str) -> list[str]:
    return re.findall(r"((?:\w+\.)+\w+)\s*\(", code)


def parse_jsp(path: str, text: str) -> list[Chunk]:
    """Directives, scriptlets and expressions, forms and tags, includes, and sections of more than fifty visible characters."""
    line = lambda i: text.count("\n", 0, i) + 1
    name = path.rpartition("/")[2]
    out: list[Chunk] = []

    def chunk(m_start: int, content: str, kind: str, mvc: dict[str, str], metadata: dict, calls: list[str] | None = None) -> None:
        first = line(m_start)
        out.append(Chunk(content, "JSP_FRAGMENT", path, f"{name}#{kind}", first, first + content.count("\n"), api_calls=calls or [], mvc={k: v for k, v in mvc.items() if v}, metadata={"fragmentType": kind} | metadata))

    for m in _JSP.finditer(text):
        if m[1] is not None:
            kind = next((k for k in ("page", "taglib", "include") if k in m[1]), "other")
            chunk(m.start(), m[0], "DIRECTIVE", {"includePath": attribute(m[1], "file")} if "include" in m[1] else {}, {"directiveType": kind})
    for m in _JSP.finditer(text):
        code = m[2] if m[2] is not None else m[3]
        if code is not None:
            chunk(m.start(), m[0], "EXPRESSION" if m[2] is not None else "SCRIPTLET", {}, {"javaCode": code.strip(), "hasJavaCode": bool(code.strip())}, dotted_calls(code))
    for m in _FORM.finditer(text):
        fields = len(re.findall(r"<(?:html:)?(?:input|select|textarea|text|password|hidden|checkbox|radio)\b", m[3], re.I))
        chunk(m.start(), m[0], "FORM", {"actionPath": attribute(m[2], "action"), "httpMethod": attribute(m[2], "method"), "formName": attribute(m[2], "name")}, {"fieldCount": fields})
    for m in _TAG.finditer(text):
        kind, a = m[2], m[3]
        if m[1] == "logic":
            chunk(m.start(), m[0], "LOGIC", {"logicType": kind, "beanName": attribute(a, "name"), "beanProperty": attribute(a, "property"), "compareValue": attribute(a, "value")}, {})
        elif m[1] == "bean":
            chunk(m.start(), m[0], "BEAN", {"beanType": kind, "beanName": attribute(a, "name"), "beanProperty": attribute(a, "property"), "beanId": attribute(a, "id")}, {})
        elif attribute(a, "page"):
            chunk(m.start(), m[0], "INCLUDE", {"includePath": attribute(a, "page"), "targetPage": attribute(a, "page"), "includeType": f"{m[1]}:{kind}"}, {})
    bare = _JSP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for m in re.finditer(r"<(div|table|form)\b([^>]*)>", bare, re.I):
        tag, a = m[1].lower(), m[2]
        if tag == "div" and not (attribute(a, "id") or re.search("section|container", attribute(a, "class"))):
            continue
        depth, end = 0, len(bare)
        for t in re.finditer(rf"<(/?){tag}\b[^>]*>", bare[m.start() :], re.I):
            depth += -1 if t[1] else 1
            if not depth:
                end = m.start() + t.end()
                break
        visible = " ".join(re.sub(r"<[^>]*>", " ", bare[m.start() : end]).split())
        if len(visible) > 50:
            chunk(m.start(), text[m.start() : end], "SECTION", {}, {"htmlTag": tag, "cssClass": attribute(a, "class"), "htmlId": attribute(a, "id"), "textLength": len(visible)})
    return out


PARSERS = {"config": parse_config, "java": parse_java, "jsp": parse_jsp}


def parse_any(path: str, text: str) -> list[Chunk]:
    """By the path: configuration first, then Java and JSP; other files have no chunks."""
    name = path.rpartition("/")[2].lower()
    if name in ("web.xml", "struts-config.xml", "tiles-defs.xml") or ("struts" in name and name.endswith(".xml")):
        return parse_config(path, text)
    return parse_java(path, text) if path.endswith(".java") else parse_jsp(path, text) if name.endswith((".jsp", ".jspx")) else []
