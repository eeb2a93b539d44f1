"""Definitions of brace languages, read by a state machine over a file's tokens.

Strings, comments, templates, regular expressions and preprocessor lines are tokens that hold nothing, so a
brace in them moves no end line; names and bodies may stand on other lines than their keyword. Time is linear in
the file.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: The deepest definition that is listed, from 0; tokens looked at for the name of a method; the longest signature.
DEPTH, HEADER, SIGNATURE = 3, 200, 150

_C = {"struct": "struct", "enum": "enum", "union": "struct"}
_CPP = _C | {"class": "class"}
_JS = {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type", "const": "const", "let": "const"}
_NET = {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "record": "class"}
#: Keywords that begin a definition, and its kind.
KEYWORDS = {
    "typescript": _JS, "javascript": _JS, "go": {"func": "function", "type": "type"}, "rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "class"},
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}, "csharp": _NET, "c": _C, "h": _CPP, "cpp": _CPP, "hpp": _CPP, "cc": _CPP,
    "php": {"function": "function", "class": "class", "interface": "interface", "trait": "trait"}, "kt": {"fun": "function", "class": "class", "object": "class", "interface": "class"},
    "swift": {"func": "function", "class": "class", "struct": "class", "enum": "class", "protocol": "class"},
}
#: Languages whose methods, and whose functions outside classes, have no keyword.
METHODS, FUNCTIONS = {"typescript", "javascript", "java", "csharp", "h", "cpp", "hpp", "cc"}, {"c", "h", "cpp", "hpp", "cc"}
CONTROL = frozenset("if for while switch catch return new do else try finally synchronized using lock foreach sizeof function await yield throw case with fixed unsafe checked when".split())
HOLDS = {"class", "interface", "struct", "enum", "trait"}
#: A / begins a regular expression after these.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => return typeof case in of delete void throw new else do".split()) | {""}

#: A { behind these opens a type, not a body.
_TYPED = frozenset("< : | & ,".split())

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_TEMPLATE, _TRIPLE, _RAW = r"`(?:\\.|[^`\\])*`?", r'"""(?:.*?"""|.*\Z)', r"`[^`]*`?"
_PREPROCESSED = r"(?m:^)[ \t]*#(?:\\\n|[^\n])*"
_SKIPPED = {
    "typescript": [_LINE, _BLOCK, _DOUBLE, _SINGLE, _TEMPLATE], "go": [_LINE, _BLOCK, _DOUBLE, _SINGLE, _RAW],
    "rust": [_LINE, _BLOCK, r'\bb?r(?P<h>#*)".*?(?:"(?P=h)|\Z)', _DOUBLE, r"'(?:\\[^'\n]+|[^'\\\n])'"],
    "java": [_LINE, _BLOCK, _TRIPLE, _DOUBLE, _SINGLE], "csharp": [_LINE, _BLOCK, _PREPROCESSED, r'\$?@\$?"(?:""|[^"])*"?', _TRIPLE, _DOUBLE, _SINGLE],
    "c": [_LINE, _BLOCK, _PREPROCESSED, r'\bR"(?P<h>\w*)\(.*?(?:\)(?P=h)"|\Z)', _DOUBLE, _SINGLE], "php": [_LINE, _BLOCK, r"#(?!\[)[^\n]*", r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\])*'?"],
    "kt": [_LINE, _BLOCK, _TRIPLE, _DOUBLE, _SINGLE], "swift": [_LINE, _BLOCK, _TRIPLE, r'(?P<h>#+)".*?(?:"(?P=h)|\Z)', _DOUBLE],
}
_SKIPPED |= {"javascript": _SKIPPED["typescript"]} | dict.fromkeys(("h", "cpp", "hpp", "cc"), _SKIPPED["c"])
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_TOKEN = {k: re.compile("(?P<skip>" + "|".join(v) + r")|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|\d[\w.]*|=>|->|::|(?P<sign>[^\w\s])", re.S) for k, v in _SKIPPED.items()}


class Token(NamedTuple):
    text: str
    line: int
    word: bool
    fresh: bool  # the first one of its line


def tokens(content: str, lang: str) -> list[Token]:
    """Words and signs outside strings and comments; a skipped string is the token "" (comments are none)."""
    out: list[Token] = []
    at, line, seen, last = 0, 1, 0, 0
    pattern, js = _TOKEN[lang], lang in ("typescript", "javascript")
    while m := pattern.search(content, at):
        begin, at = m.start(), m.end()
        line += content.count("\n", seen, begin)
        seen = begin
        text = m.group()
        if text == "/" and js and (out[-1].text if out else "") in _BEFORE_REGEX and (r := _REGEX.match(content, begin)):
            at, text = r.end(), '"'
        if m["skip"] is not None:
            if text.startswith(("//", "/*", "#")) or text.lstrip().startswith("#") and not text.lstrip().startswith('#"'):
                continue
            text = '"'
        out.append(Token(text, line, m["word"] is not None, line > last))
        last = line
    return out


class _Definition:
    def __init__(self, name: str, kind: str, line: int, parent: _Definition | None, depth: int) -> None:
        self.name, self.kind, self.line, self.end, self.parent, self.depth = name, kind, line, line, parent, depth


def _past(ts: list[Token], i: int, opening: str, closing: str) -> int:
    """The place behind the bracket that closes the one at i, or HEADER tokens on."""
    depth, end = 0, min(len(ts), i + HEADER)
    while i < end:
        depth += (ts[i].text == opening) - (ts[i].text == closing)
        i += 1
        if not depth:
            break
    return i


def _named(ts: list[Token], i: int, lang: str, kind: str) -> tuple[str, str] | None:
    """(name, kind) of the definition whose keyword is at i; None where it is none."""
    word, prev = ts[i].text, ts[i - 1].text if i else ""
    if prev in (".", "::", "->"):
        return None
    j = i + 1
    if word == "impl":
        if j < len(ts) and ts[j].text == "<":
            j = _past(ts, j, "<", ">")
        name = None
        while j < min(len(ts), i + HEADER) and ts[j].text not in ("{", ";", "where"):
            if ts[j].text == "<":
                j = _past(ts, j, "<", ">")
                continue
            if ts[j].text == "for":
                name = None
            elif ts[j].word and (name is None or ts[j - 1].text == "::"):
                name = ts[j].text
            j += 1
        return (name, kind) if name else None
    if word == "func" and j < len(ts) and ts[j].text == "(":
        j, kind = _past(ts, j, "(", ")"), "method"
    if word == "fun":  # a receiver type may stand before the name
        while j + 2 < min(len(ts), i + HEADER) and ts[j + 1].text in (".", "<", "?") and ts[j].word:
            j = _past(ts, j + 1, "<", ">") if ts[j + 1].text == "<" else j + 2
            j += j < len(ts) and ts[j].text == "."
    while j < len(ts) and ts[j].text in ("*", "&"):
        j += 1
    if j >= len(ts) or not ts[j].word or lang == "go" and word == "func" and ts[j].text in ("(", "{"):
        return None
    if word == "enum" and ts[j].text in ("class", "struct") or word == "const" and ts[j].text == "enum" or word == "record" and ts[j].text in ("class", "struct"):
        return None if word == "const" else _named(ts, j, lang, kind)
    after = ts[j + 1].text if j + 1 < len(ts) else ""
    if lang in FUNCTIONS and after not in ("{", ":", "final"):
        return None  # the type of something else
    if word == "type" and (lang == "go" and after not in ("struct", "interface") or lang != "go" and after not in ("=", "<")):
        return None
    if word == "record" and after not in ("(", "<", "{", ":", ";"):
        return None
    if kind in HOLDS and prev in ("<", ",", "(") and lang in ("java", "kt", "csharp"):
        return None
    return ts[j].text, kind


def _method(header: list[Token]) -> str | None:
    """The name of a method or function whose body opens behind these tokens."""
    i = 0
    while i < len(header):
        t = header[i]
        if t.text == "@" and i + 1 < len(header):  # an annotation with its arguments
            i += 2
            if i < len(header) and header[i].text == "(":
                i = _past(header, i, "(", ")")
            continue
        if t.text in ("=", "=>"):
            return None
        if t.text == "(":
            name = header[i - 1] if i else None
            return name.text if name and name.word and name.text not in CONTROL else None
        i += 1
    return None


def _over(d: _Definition, ts: list[Token], i: int, lang: str) -> bool:
    """Whether a definition without a body or an end sign is over where a word begins the line at token i."""
    if not (d.kind in ("const", "type") and lang in ("typescript", "javascript") or d.kind == "function" and lang == "kt"):
        return False
    if ts[i - 1].text in ("=", "=>", "(", ",", "|", "&", "+", "?", ":", "<", "->"):
        return False
    return d.kind != "function" or any(x.text == "=" for x in ts[max(0, i - HEADER) : i] if x.line >= d.line)


def definitions(content: str, lang: str) -> list[tuple]:
    """(name, kind, line, end_line, signature, parent_name) of a file's definitions, in order: parent is the definition that
    encloses one, and those within more than DEPTH others are left out. The signature is the first line."""
    ts, lines, found = tokens(content, lang), content.split("\n"), []
    scopes: list[tuple[_Definition | None, int]] = []  # what each open brace belongs to, and the brackets open around it
    owners: list[_Definition] = []
    waiting: list[tuple[_Definition, int, int]] = []  # definitions whose body may come: with the brackets and braces around them
    brackets, header, keywords = 0, [], KEYWORDS[lang]
    go_types = lang == "go"

    def begin(name: str, kind: str, line: int) -> _Definition:
        d = _Definition(name, kind, line, owners[-1] if owners else None, len(owners))
        found.append(d)
        return d

    for i, t in enumerate(ts):
        here = len(scopes)
        if t.fresh and t.word and waiting and waiting[-1][1:] == (brackets, here) and _over(waiting[-1][0], ts, i, lang):
            waiting.pop()[0].end = ts[i - 1].line
        if t.word and t.text in keywords and not (i and ts[i - 1].text == "enum"):  # enum class is one keyword
            told = _named(ts, i, lang, keywords[t.text])
            if told and told[1] == "const" and (here or brackets):
                told = None
            if told:
                while waiting and waiting[-1][1:] == (brackets, here) and waiting[-1][0].kind in ("const", "type"):
                    waiting.pop()  # the one before had no end sign
                waiting.append((begin(*told, t.line), brackets, here))
        elif go_types and t.word and t.fresh and brackets and i + 2 < len(ts) and ts[i + 1].text in ("struct", "interface") and ts[i + 2].text == "{":
            waiting.append((begin(t.text, "type", t.line), brackets, here))  # in a group of types
        if t.text in "([" and t.text:
            brackets += 1
        elif t.text in (")", "]"):
            brackets = max(0, brackets - 1)
        if t.text == "{":
            owner = None
            if waiting and waiting[-1][1:] == (brackets, here):
                if not (i and (ts[i - 1].text in _TYPED or waiting[-1][0].kind in ("function", "method") and ts[i - 1].text in ("struct", "interface"))):
                    owner = waiting.pop()[0]  # else the brace opens a type in the head
            elif not brackets or scopes and brackets == scopes[-1][1]:
                inside = scopes[-1][0] if scopes else None
                holder = inside is not None and inside.kind in HOLDS
                free = lang in FUNCTIONS and not owners
                if (holder and lang in METHODS or free) and (name := _method(header)):
                    owner = begin(name, "method" if holder else "function", next((x.line for x in header if x.text == name), t.line))
            scopes.append((owner, brackets))
            if owner:
                owners.append(owner)
        elif t.text == "}" and scopes:
            owner, brackets = scopes.pop()
            while waiting and waiting[-1][2] > len(scopes):
                waiting.pop()
            if owner:
                owner.end = t.line
                owners.pop()
        elif t.text == ";" and (not scopes or brackets == scopes[-1][1]):
            while waiting and waiting[-1][1:] == (brackets, here):
                waiting.pop()[0].end = t.line
        if t.text in ("{", "}", ";") or lang in FUNCTIONS and t.text == ":" and len(header) == 1:
            header = []
        elif len(header) < HEADER:
            header.append(t)
    last = ts[-1].line if ts else 1
    for owner, _ in scopes:
        if owner:
            owner.end = last
    cut = lambda s: s if len(s) <= SIGNATURE else s[:SIGNATURE] + "..."
    return [(d.name, d.kind, d.line, d.end, cut(lines[d.line - 1].strip()), d.parent.name if d.parent else None) for d in found if d.depth <= DEPTH]
