"""Declarations, calls and hashes of source texts, for reconciling nodes with what the sources hold."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings

EXTENSIONS = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "rs": "rust", "java": "java"}
_NOISE = {
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)+'"),
    "java": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)+'"),
    "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|r(#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|'(?:[^'\\\n]|\\(?:u\{\w+\}|x..|.))'"),
    "typescript": re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"),
}
_DECLARED = {
    "go": re.compile(r"^(?:func[ \t]+(?:\([ \t]*(?:\w+[ \t]+)?\*?[ \t]*(?P<owner>\w+)(?:\[[^\]]*\])?[ \t]*\)[ \t]*)?(?P<fn>\w+)|type[ \t]+(?P<type>\w+)|(?:var|const)[ \t]+(?P<value>\w+))", re.M),
    "typescript": re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:async[ \t]+)?(?:function\*?[ \t]+(?P<fn>[\w$]+)|(?:class|interface|enum|type|namespace)[ \t]+(?P<type>[\w$]+)|(?:const|let|var)[ \t]+(?P<value>[\w$]+))", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:const|async|unsafe|extern)[ \t]+)*(?:fn[ \t]+(?P<fn>\w+)|(?:struct|enum|trait|union|type|mod)[ \t]+(?P<type>\w+)|(?:const|static)[ \t]+(?:mut[ \t]+)?(?P<value>[A-Z]\w*))", re.M),
    "java": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed|synchronized|default|native|strictfp)[ \t]+)*(?:(?:class|interface|enum|record)[ \t]+(?P<type>\w+)|(?:<[^>]*>[ \t]*)?[\w.<>\[\], ?]+[ \t]+(?P<fn>\w+)[ \t]*\((?=[^;]*\)[^;]*\{))", re.M),
}
#: The line comment by which tools mark what they write (fixed value).
_MARKER = re.compile(r"// Code generated .* DO NOT EDIT\.")


def blanked(text: str, lang: str) -> str:
    """The text with comments and literals as blanks, every other character in its place."""
    return _NOISE[lang].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def normal(text: str, lang: str, name: str = "") -> str:
    """The text without comments and runs of blanks, its own name replaced, so that a renamed copy has the same hash."""
    bare = _NOISE[lang].sub(lambda m: " " if m.group()[:2] in ("//", "/*") else m.group(), text)
    bare = re.sub(r"\s+", " ", bare).strip()
    return re.sub(rf"\b{re.escape(name)}\b", "\x00", bare) if name else bare


def _block(bare: str, start: int, end: int) -> int:
    """Where a declaration ends: at the brace that closes its first one, else at its line's end or semicolon."""
    depth = 0
    for m in re.compile(r"[{};\n]").finditer(bare, start, end):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif not depth and (c == ";" or c == "\n" and not bare[m.end() : m.end() + 1].isspace()):
            return m.end()
    return end


def declarations(text: str, lang: str) -> list[tuple]:
    """(name, kind, first line, last line, signature, hash, structural hash) in source order; a name that repeats gets ``~2`` ...

    Python is read with its own parser (none from a text it refuses), other languages by scanning.
    """
    found = []
    if lang == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        lines = text.splitlines()

        def take(node, owner: str) -> None:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{node.name}" if owner else node.name
                kind = "decl" if isinstance(node, ast.ClassDef) else "function"
                dumped = ast.dump(node)
                found.append((name, kind, node.lineno, node.end_lineno, lines[node.lineno - 1].strip(), digest(dumped), digest(dumped.replace(f"name='{node.name}'", "name='\x00'", 1))))
                if kind == "decl":
                    for x in node.body:
                        take(x, name)

        for node in tree.body:
            take(node, "")
    elif lang in _DECLARED:
        bare = blanked(text, lang)
        for m in _DECLARED[lang].finditer(bare):
            fn, kind = m.groupdict().get("fn"), "function"
            if not fn:
                fn, kind = m.groupdict().get("type") or m.groupdict().get("value"), "decl"
            if lang == "java" and fn in ("if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new"):
                continue
            owner = m.groupdict().get("owner")
            end = _block(bare, m.end(), len(bare))
            body = text[m.start() : end]
            name = f"{owner}.{fn}" if owner else fn
            first = text.count("\n", 0, m.start()) + 1 + (m.group().startswith("\n"))
            found.append((name, kind, first, text.count("\n", 0, end - 1) + 1, body.split("\n")[0].split("{")[0].strip(), digest(normal(body, lang)), digest(normal(body, lang, fn))))
    seen: dict[str, int] = {}
    out = []
    for d in found:
        seen[d[0]] = seen.get(d[0], 0) + 1
        out.append((d[0] if seen[d[0]] == 1 else f"{d[0]}~{seen[d[0]]}", *d[1:]))
    return out


_CALL = re.compile(r"(?<![\w.])(?:([A-Za-z_]\w*)[ \t]*\.[ \t]*)?([A-Za-z_]\w*)[ \t]*\(")
_GO_WORDS = {"func", "if", "for", "switch", "select", "return", "go", "defer", "range", "make", "new", "len", "cap", "append", "panic", "recover", "copy", "delete", "close", "print", "println", "min", "max", "clear", "map", "chan", "type", "interface", "struct", "string", "int", "byte", "rune", "error", "bool"}
_GO_FUNC = re.compile(r"^func[ \t]+(?:\([ \t]*(?:(?P<recv>\w+)[ \t]+)?\*?[ \t]*(?P<owner>\w+)(?:\[[^\]]*\])?[ \t]*\)[ \t]*)?(?P<name>\w+)|^(?P<word>type|var|const)\b[ \t]*(?P<group>\()?", re.M)
_SPEC = re.compile(r"[ \t]*(?P<names>[A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)")


def _close(bare: str, at: int) -> int:
    """Where the bracket at ``at`` is closed; the text's end if nowhere."""
    depth = 0
    for m in re.compile(r"[(){}\[\]]").finditer(bare, at):
        depth += 1 if m.group() in "([{" else -1
        if not depth:
            return m.start()
    return len(bare)


def _specs(bare: str, at: int, end: int):
    """(start, end) of the specs of a group: lines at the group's own depth, with what their brackets hold."""
    start = at
    k = at
    while k < end:
        c = bare[k]
        if c in "([{":
            k = min(end, _close(bare, k))
        elif c in "\n;":
            if bare[start:k].strip():
                yield start, k
            start = k + 1
        k += 1
    if bare[start:end].strip():
        yield start, end


def go_declared(bare: str):
    """(names, kind, receiver's name, owner, start, end) of all top-level declarations, specs of groups one by one."""
    for m in _GO_FUNC.finditer(bare):
        if m["name"]:
            yield [f"{m['owner']}.{m['name']}" if m["owner"] else m["name"]], "func", m["recv"] or "", m["owner"] or "", m.end(), _block(bare, m.end(), len(bare))
            continue
        spans = _specs(bare, m.end(), _close(bare, m.end() - 1)) if m["group"] else [(m.end(), _block(bare, m.end(), len(bare)))]
        for start, end in spans:
            if n := _SPEC.match(bare, start, end):
                yield [x.strip() for x in n["names"].split(",")], m["word"], "", "", n.end(), end


def go_file(text: str) -> tuple[str, dict[str, str], list[str], list[tuple[str, str, str]], list[tuple[str, list[str], list[tuple[str, str]]]]]:
    """Package, imports (name to path), declared names, calls (caller, qualifier, name) and interfaces (name, methods, embedded) of a Go file.

    A call of the receiver's own method has no qualifier and the owner before its name. Calls through longer chains aren't
    resolved. What an interface embeds is (qualifier, name); ('', '!') is a constraint, which is no method set. Imports whose
    names go into the file's own names or nowhere don't count.
    """
    bare = blanked(text, "go")
    package = (re.search(r"^package[ \t]+(\w+)", bare, re.M) or [None, ""])[1]
    imports = {}
    for m in re.finditer(r"^import[ \t]*(?:\((?P<many>[^)]*)\)|(?P<one>[^\n]*))", text, re.M):
        for line in (m["many"] or m["one"] or "").split("\n"):
            if (x := re.match(r"[ \t]*(?:(\w+|\.)[ \t]+)?\"([^\"]+)\"", line)) and x[1] not in (".", "_"):
                imports[x[1] or x[2].rsplit("/", 1)[-1]] = x[2]
    declared, calls, interfaces, seen = [], [], [], {}
    for names, kind, recv, owner, start, end in go_declared(bare):
        own = []
        for name in names:
            seen[name] = seen.get(name, 0) + 1
            own.append(name if seen[name] == 1 else f"{name}~{seen[name]}")
        declared.extend(own)
        body = bare.find("{", start, end) if kind == "func" else bare.find("=", start, end) if kind == "var" else -1
        if body >= 0:
            found = [(c[1] or "", c[2]) for c in _CALL.finditer(bare, body, end) if c[1] or c[2] not in _GO_WORDS]
            found = [("", f"{owner}.{n}") if q and q == recv else (q, n) for q, n in found]
            calls.extend((caller, q, n) for caller in own for q, n in dict.fromkeys(found))
        if kind == "type" and (x := re.match(r"[ \t]*(?:\[[^\]]*\])?[ \t]*interface[ \t]*\{", bare[start:end])):
            methods, embedded = [], []
            inner = start + x.end()
            for a, b in _specs(bare, inner, _close(bare, inner - 1)):
                line = bare[a:b].strip()
                if y := re.match(r"([A-Za-z_]\w*)[ \t]*\(", line):
                    methods.append(y[1])
                elif y := re.fullmatch(r"(?:([A-Za-z_]\w*)\.)?([A-Za-z_]\w*)", line):
                    embedded.append((y[1] or "", y[2]))
                else:
                    embedded.append(("", "!"))
            interfaces.append((own[0], methods, embedded))
    return package, imports, declared, calls, interfaces


def generated(text: str) -> bool:
    """Whether one of the line comments before the first code, within the first 64 KiB, is exactly the marker of generated code."""
    lead = re.match(rb"(?:[ \t\r\n\f\v]+|//[^\n]*\n?|/\*[\s\S]*?\*/)*", text.encode()[:65536]).group().decode(errors="replace")
    bare = re.sub(r"/\*[\s\S]*?\*/|(//[^\n]*)", lambda m: m[1] or " ", lead)
    return any(_MARKER.fullmatch(line.strip(" \t\f\v").removesuffix("\r")) for line in bare.split("\n"))
