"""Symbols and relations of Rust, Go and TypeScript or JavaScript sources (O-05, O-06, O-08, O-09).

No parser of these languages is at hand, so declarations are found by their keywords in text whose comments and literals
are blanked, and reach to their closing brace. What needs types or macro expansion is not seen; provider facts tables add it.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable

_ID = r"[A-Za-z_$][\w$]*"
_LITERALS = {
    "rust": r"//[^\n]*|/\*.*?\*/|b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n]*?|[^'\\\n])'",
    "go": r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "typescript": r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
}
_DECLARED = {
    "rust": rf"(?P<vis>\bpub(?:\([^)]*\))?\s+)?(?:\b(?:default|async|unsafe|extern|const(?=\s+(?:unsafe|extern|async|fn)\b))\s+)*\b(?P<word>fn|struct|enum|union|trait|mod|type|static|const|use|impl|macro_rules!)(?:\s+mut\b)?(?P<type>(?<=impl)\s*<[^{{;]*?>(?=\s))?\s+(?P<name>{_ID})",
    "go": rf"^(?P<word>func|type|const|var|import)\b[ \t]*(?:\((?P<on>[^)]*)\)[ \t]*(?=\w+[ \t]*[(\[]))?(?P<name>{_ID})?",
    "typescript": rf"(?P<vis>\bexport\s+)?(?:\b(?:default|declare|abstract|async)\s+)*\b(?P<word>class|interface|enum|namespace|function|type|const|let|var|import)\b\s*\*?\s*(?P<name>{_ID})?",
}
_NOT_CALLS = {"if", "for", "while", "match", "switch", "return", "fn", "func", "function", "catch", "loop", "in", "as", "new", "typeof", "await", "Some", "Ok", "Err", "None", "make", "len", "append", "constructor", "super", "import"}
_RUST_KINDS = {"fn": "function", "mod": "module", "type": "type_alias", "macro_rules!": "macro", "union": "struct"}
_TS_KINDS = {"let": "variable", "var": "variable", "type": "type_alias"}


def blank(source: str, language: str) -> str:
    """The source with comments and literals as blanks, line for line and character for character."""
    return re.compile(_LITERALS[language], re.DOTALL).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


class _Scan:
    def __init__(self, path: str, source: str, language: str, test_file: bool) -> None:
        self.path, self.source, self.language, self.test_file = path, source, language, test_file
        self.text = blank(source, language)
        self.lines = [0, *[m.end() for m in re.finditer("\n", source)]]
        self.bytes = [0]
        for a, b in zip(self.lines, [*self.lines[1:], len(source)]):
            self.bytes.append(self.bytes[-1] + len(source[a:b].encode()))
        self.closes, open_at = {}, []
        for m in re.finditer(r"[(\[{}\])]", self.text):
            if m.group() in "([{":
                open_at.append(m.start())
            elif open_at:
                self.closes[open_at.pop()] = m.start()
        self.rows: list[dict] = []

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at) - 1

    def byte(self, at: int) -> int:
        k = self.line(at)
        return self.bytes[k] + len(self.source[self.lines[k] : at].encode())

    def reach(self, at: int, ends: str = ";") -> tuple[int, int | None]:
        """Where a declaration that goes on at ``at`` ends, and its opening brace if it has one."""
        while at < len(self.text):
            c = self.text[at]
            if c == "{":
                return self.closes.get(at, len(self.text) - 1) + 1, at
            if c in "([" and at in self.closes:
                at = self.closes[at]
            elif c in ends or c == "}":
                return (at + 1 if c == ";" else at), None
            at += 1
        return len(self.text), None

    def add(self, name: str, kind: str, start: int, end: int, body: int | None, visibility: str, relations: set[tuple[str, str]], **more) -> None:
        self.rows.append({"name": name, "kind": kind, "start": start, "end": end, "body": body, "visibility": visibility, "relations": relations, "test": False, "root": False, "retain": 0, "owner": "", **more})

    def calls(self, a: int, b: int) -> set[tuple[str, str]]:
        return {("calls", n) for n in re.findall(rf"({_ID})(?:::<[^>()]*>)?\s*\(", self.text[a:b]) if n not in _NOT_CALLS}

    def types(self, a: int, b: int) -> set[tuple[str, str]]:
        return {("type_of", n) for n in re.findall(r"\b([A-Z]\w+)\b", self.text[a:b])}

    def finish(self) -> list[tuple]:
        """Rows of the extractors' schema, in source order, each with the names of what encloses it."""
        out, around = [], []
        for r in sorted(self.rows, key=lambda r: (r["start"], -r["end"])):
            while around and around[-1]["end"] <= r["start"]:
                around.pop()
            scope = [x["owner"] or x["name"] for x in around]
            test = self.test_file or r["test"] or any(x["test"] for x in around)
            kind = "method" if r["kind"] == "function" and (r["owner"] or around and around[-1]["kind"] in ("impl", "trait", "class", "interface")) else r["kind"]
            parent = r["owner"] if kind == "method" and r["owner"] else "::".join(scope)
            a, b = self.byte(r["start"]), self.byte(r["end"])
            signature = self.source[r["start"] : r["body"] if r["body"] else r["end"]].strip().split("\n")[0].strip()
            has_body = r["body"] is not None if kind in ("function", "method", "constructor", "callable_value") else None
            out.append(
                (self.path, r["name"], kind, parent, a, b, self.line(r["start"]), self.line(max(r["start"], r["end"] - 1)), signature, None, hashlib.sha256(self.source[r["start"] : r["end"]].encode()).hexdigest(),
                 r["visibility"], test, bool(r["root"]), has_body, r["retain"], [{"tag": t, "target": x} for t, x in sorted(r["relations"])])
            )
            if r["body"] is not None and kind not in ("function", "method", "constructor"):
                around.append(r)
        return out


def extract_rust(path: str, source: str) -> list[tuple]:
    """Functions, methods, types, traits, impls, constants, modules, uses, aliases, macros and fields of a Rust document."""
    s = _Scan(path, source, "rust", "tests" in path.split("/")[:-1] or path.endswith("_tests.rs"))
    for m in re.finditer(_DECLARED["rust"], s.text):
        word, name = m["word"], m["name"]
        before = re.search(r"(?:#!?\[[^\n]*\]\s*)*$", s.text[: m.start()]).group()
        end, body = s.reach(m.end())
        vis = (m["vis"] or "private").strip()
        kind, links, owner, head = _RUST_KINDS.get(word, word), set(), "", s.text[m.end() : body or end]
        if word == "impl":
            whole = name + head
            of = re.match(rf"(?P<trait>[\w:]+)(?:<.*?>)?\s+for\s+(?:&\s*)?(?P<type>[\w:]+)", whole)
            owner = (of["type"] if of else re.match(r"[\w:]+", whole).group()).rpartition("::")[2]
            name, links = (f"{of['trait'].rpartition('::')[2]} for {owner}", {("implements", of["trait"].rpartition("::")[2])}) if of else (owner, set())
        elif word == "use":
            links = {("references", n) for n in re.findall(rf"({_ID})\s*(?=[,;}}]|\bas\b)", s.text[m.end("word") : end])}
            name = re.sub(r"\s+", " ", s.text[m.end("word") : end]).strip(" ;")
        elif word == "fn":
            links = s.types(m.end(), body or end) | (s.calls(body, end) if body else set())
        elif word == "trait":
            links = {("extends", n.rpartition("::")[2]) for n in re.findall(r"[\w:]+", head.partition(":")[2].partition("where")[0])}
        elif word in ("const", "static", "type"):
            links = s.types(m.end(), end)
        elif word in ("struct", "enum", "union") and body and word != "enum":
            for f in re.finditer(rf"(?:(?<=[{{,])|(?<=\]))\s*(?P<v>pub(?:\([^)]*\))?\s+)?(?P<n>{_ID})\s*:(?!:)(?P<t>[^,}}]*)", s.text[body:end]):
                s.add(f["n"], "field", body + f.start("v" if f["v"] else "n"), body + f.end(), None, (f["v"] or "private").strip(), {("type_of", n) for n in re.findall(r"\b([A-Z]\w+)\b", f["t"])})
        retain = int(bool(re.search(r"no_mangle|export_name|\bused\b|proc_macro", before)))
        s.add(name, kind, m.start(), end, body, vis, links, owner=owner if word == "impl" else "", test="cfg(test)" in before.replace(" ", ""), root=bool(re.search(r"#\[(?:\w+::)*test\b", before)), retain=retain)
    return s.finish()


def extract_go(path: str, source: str) -> list[tuple]:
    """Functions, methods with their receivers, structs, interfaces, constants, variables, imports and fields of a Go document."""
    s = _Scan(path, source, "go", path.endswith("_test.go"))
    shown = lambda n: "pub" if n[:1].isupper() else "private"
    for m in re.finditer(_DECLARED["go"], s.text, re.MULTILINE):
        word, name, at = m["word"], m["name"], m.end()
        if word == "func" and name:
            end, body = s.reach(at, "\n")
            on = re.findall(r"\w+", re.sub(r"\[.*?\]", "", m["on"] or ""))
            s.add(name, "function", m.start(), end, body, shown(name), s.types(at, body or end) | (s.calls(body, end) if body else set()), owner=on[-1] if on else "", root=s.test_file and name.startswith(("Test", "Benchmark", "Fuzz", "Example")))
        elif word == "type" and name:
            end, body = s.reach(at, "\n")
            of = s.text[at : body if body else end].split()
            kind = "struct" if of[-1:] == ["struct"] else "trait" if of[-1:] == ["interface"] else "type_alias"
            s.add(name, kind, m.start(), end, body if kind != "type_alias" else None, shown(name), s.types(at, end) if kind == "type_alias" else set())
            for f in re.finditer(rf"^[ \t]*(?P<n>{_ID})(?P<t>[ \t]+[^\n]*|\([^\n]*)$", s.text[body + 1 : end - 1], re.MULTILINE) if body and kind != "type_alias" else ():
                method = f["t"].startswith("(")
                s.add(f["n"], "function" if method else "field", body + 1 + f.start("n"), body + 1 + f.end(), None, shown(f["n"]), {("type_of", x) for x in re.findall(r"\b([A-Z]\w+)\b", f["t"])}, owner=name if method else "")
        elif word in ("const", "var", "import"):
            opened = re.compile(r"[ \t]*\(").match(s.text, at)
            group = opened.end() - 1 if opened and not name else None
            a, b = (group + 1, s.closes.get(group, len(s.text))) if group is not None else (m.end("word"), s.reach(at, "\n")[0])
            for row in re.finditer(r"[^\n]+", s.source[a:b]):
                start, line = a + row.start() + len(row.group()) - len(row.group().lstrip()), row.group().strip()
                if word == "import":
                    if target := re.match(r"(?:(?P<as>[\w.]+)\s+)?[\"`](?P<path>[^\"`]+)", line):
                        last = target["path"].rpartition("/")[2]
                        s.add(target["as"] or last, "import", start, a + row.end(), None, "private", {("references", last)})
                elif names := re.match(rf"{_ID}(?:\s*,\s*{_ID})*", s.text[start : a + row.end()]):
                    for n in re.findall(_ID, names.group()):
                        s.add(n, "const" if word == "const" else "static", start, a + row.end(), None, shown(n), s.types(start + names.end(), a + row.end()))
    return s.finish()


def extract_typescript(path: str, source: str) -> list[tuple]:
    """Classes, interfaces, enums, namespaces, members, functions, callable values, aliases, imports and exports of a document."""
    s = _Scan(path, source, "typescript", bool(re.search(r"\.(?:test|spec)\.[cm]?[jt]sx?$", path)) or "__tests__" in path.split("/"))
    for m in re.finditer(_DECLARED["typescript"], s.text):
        word, name, at = m["word"], m["name"], m.end()
        vis = "pub" if m["vis"] else "private"
        if word == "import":
            end, _ = s.reach(m.end("word"), ";\n") if "{" not in s.text[m.start() : s.text.find("\n", m.start()) % (len(s.text) + 1)] else (s.text.find("\n", m.start()) % (len(s.text) + 1), None)
            for x, y in re.findall(rf"({_ID})(?:\s+as\s+({_ID}))?", re.sub(r"\bfrom\b|\btype\b", " ", s.text[m.end("word") : end])):
                s.add(y or x, "import", m.start(), end, None, "private", {("references", x)})
        elif word in ("class", "interface", "enum", "namespace") and name:
            end, body = s.reach(at)
            head = s.text[at : body or end]
            links = {("extends", n) for part in re.findall(r"extends\s+([\w$.,\s]+?)(?=implements|$|<)", head) for n in re.findall(rf"{_ID}(?=\s*(?:,|$))", part)}
            links |= {("implements", n) for part in re.findall(r"implements\s+([\w$.,\s]+)", head) for n in re.findall(rf"{_ID}(?=\s*(?:,|$))", part)}
            s.add(name, "module" if word == "namespace" else word, m.start(), end, body, vis, links)
            if body and word in ("class", "interface"):
                _members(s, body, end, name, word)
        elif word == "function" and name:
            end, body = s.reach(at)
            s.add(name, "function", m.start(), end, body, vis, s.types(at, body or end) | (s.calls(body, end) if body else set()))
        elif word == "type" and name and re.compile(r"\s*(?:<[^=]*>)?\s*=").match(s.text, at):
            end = s.reach(at, ";\n")[0]
            s.add(name, "type_alias", m.start(), end, None, vis, s.types(at, end))
        elif word in ("const", "let", "var") and name and not any(r["kind"] == "function" and r["start"] < m.start() < r["end"] for r in s.rows):
            arrow = re.compile(rf"\s*(?::[^=\n]*)?=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|{_ID}\s*=>)").match(s.text, at)
            end, body = s.reach(arrow.end() if arrow else at, ";\n")
            required = re.compile(r"\s*=\s*require\(\s*['\"]([^'\"]+)").match(s.source, at)
            kind = "callable_value" if arrow else "import" if required else _TS_KINDS.get(word, word)
            links = {("references", required[1].rpartition("/")[2])} if required else s.calls(arrow.end(), end) if arrow else set()
            s.add(name, kind, m.start(), end, body if arrow else None, vis, links)
    return s.finish()


def _members(s: _Scan, body: int, end: int, owner: str, word: str) -> None:
    at = body + 1
    pattern = re.compile(rf"\s*(?:@{_ID}(?:\([^)]*\))?\s*)*(?P<mods>(?:(?:public|private|protected|static|readonly|abstract|async|override|get|set|declare)\s+)*)\*?(?P<name>#?{_ID})\s*(?P<next>[(<?!:=;\n}}])")
    while at < end - 1:
        m = pattern.match(s.text, at)
        if not m:
            at = s.closes.get(at, at) + 1
            continue
        stop, inner = s.reach(m.end() - 1, ";\n" if m["next"] in "?!:=\n" or word == "interface" else ";")
        start = m.start("mods") if m["mods"] else m.start("name")
        hidden = "private" if re.search(r"private|protected", m["mods"]) or m["name"].startswith("#") else "pub"
        if m["next"] in "(<":
            kind = "constructor" if m["name"] == "constructor" else "property" if re.search(r"\b[gs]et\b", m["mods"]) else "function"
            s.add(m["name"], kind, start, stop, inner, hidden, s.types(m.end(), inner or stop) | (s.calls(inner, stop) if inner else set()), owner=owner if kind == "function" else "")
        else:
            s.add(m["name"], "field", start, stop, None, hidden, s.types(m.end(), stop))
        at = max(stop, m.end("name"))


EXTRACTORS: dict[str, Callable[[str, str], list[tuple]]] = {"rust": extract_rust, "go": extract_go, "typescript": extract_typescript}
