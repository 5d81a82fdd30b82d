"""Secret scanning: fixed token shapes, plus assignment-aware lexing.

The base kinds are regular expressions over the whole text. The lexing adds spans of kind ``lexed``.
Statements with an assignment are lexed: strings of all quotes (tripled ones and templates too),
dotted names, references ($K, ${K}, {{ K }}), operators, brackets. A small parser reads them into names
and expressions: plain and typed assignments, chains (a = b = "..."), subscripts (c["k"] = "..."), keys of
JSON, YAML, INI and environment files, keyword arguments, calls that set a named value, name / value
fields that follow each other, blocks of YAML and elements of XML. An expression is a concatenation of
literals and names; calls, lookups and attributes of objects are no literals.

Names are then followed to the literals that reach them, whatever the order in which they were
defined: the nearest enclosing scope (braces, bodies of def and class) that assigns a name decides,
there the last assignment before its use, else the first one after. A literal is reported when a name
that receives it is sensitive and what the name receives looks like a credential.

Defined results: null text counts as empty; an empty text has no spans, zero counts and the digest
of the empty string. Spans are in code points with an exclusive end; a literal of several strings
gives a span for each. Repeated rows give repeated results. Names, blanks and literals may be of any
length. Columns other than doc_id and text are not read. No state crosses documents, so there is
no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.common import slices, text_of, tidy

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Statements to lex are on lines with one of these, or start there.
_MARK = re.compile(r"""[=:]|\(["']""")
_TOKEN = re.compile(
    r"""(?P<blank>[ \t\r]++)
    |(?P<string>[rbfuRBFU]{0,2}(?:\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`))
    |(?P<reference>\$\{[A-Za-z_][\w.]*+\}|\$[A-Za-z_]\w*+|\{\{[ ]*+[A-Za-z_][\w.]*+[ ]*+\}\})
    |(?P<operator>:=|=>|===?|!==?|<=|>=|\+=|\?\?=|\.\.|[=:+,;])
    |(?P<bracket>[\[\](){}<>])
    |(?P<name>[A-Za-z_$][\w$]*+(?:[.-][\w$]++)*+)
    |(?P<other>[^\s,;"'`{}()\[\]<>=:+]++|.)""",
    re.X | re.S | re.A,
)
_QUOTES = re.compile("[rbfuRBFU]{0,2}(\"{3}|'{3}|[\"'`])")
_INSIDE = re.compile(r"(?:\$\{|\{\{[ ]*+)([A-Za-z_][\w.]*+)[ ]*+\}", re.A)
_DOLLAR = re.compile(r"\$([A-Za-z_]\w*+)", re.A)
_NAME = re.compile(r"[A-Za-z_$][\w$]*+(?:[.-][\w$]++)*+", re.A)
_BARE = re.compile(r"[^\s,;#\"'`{}()\[\]<>]++")
_PATH = re.compile(r"[A-Za-z_]\w{0,15}(?:\.[A-Za-z_]\w{0,15})+\Z", re.A)
_BLOCK = re.compile(r"^([ \t]*+)(?:-[ \t]+)?[\"']?([A-Za-z_][\w.-]*+)[\"']?[ \t]*+:[ \t]*+[|>][+-]?[ \t]*+\n((?:\1[ \t]+\S[^\n]*+(?:\n|\Z)|[ \t]*+\n)++)", re.M | re.A)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]++)</", re.A)
_SCOPE = re.compile(r"[{}]|^([ \t]*)(?:async[ \t]+)?(?:def|class)[ \t]", re.M)
_BRACE = re.compile("[{}]")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)
#: Words in a name and how much they suggest that it holds a credential.
_SENSITIVE = {"password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "secret": 4, "token": 3, "apikey": 4, "credential": 3, "credentials": 3, "auth": 2, "key": 2, "private": 2, "access": 1, "api": 1, "signing": 2, "encryption": 2, "bearer": 3, "dsn": 2, "salt": 2}
_HARMLESS = {"public": -3, "max": -2, "min": -2, "count": -3, "length": -3, "size": -3, "name": -2, "type": -2, "id": -1, "path": -2, "file": -2, "url": -1, "expiry": -3, "ttl": -3, "limit": -3, "tokenizer": -4}
_PLACEHOLDER = re.compile(r"(?:x{3,}|\*{3,}|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|change_?me|example|placeholder|none|null|true|false|todo|your[_-].*)\Z", re.I | re.A)
#: Sum of the scores of name and literal from which a span is reported, and the shortest literal.
THRESHOLD, SHORTEST = 5, 6


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def name_score(name: str) -> int:
    words = [w.lower() for w in _WORDS.findall(name.rsplit(".", 1)[-1])]
    return sum(_SENSITIVE.get(w, 0) + _HARMLESS.get(w, 0) for w in words)


@dataclass
class Assigned:
    """A name and what it receives: spans of literals and names, in order."""

    name: str
    at: int
    parts: list[tuple[int, int] | str]


class Statement:
    """Parses the tokens of one line (strings may end beyond it) into assignments."""

    def __init__(self, text: str, start: int, stop: int):
        self.text, self.tokens, self.end = text, [], start
        while self.end < stop:
            token = _TOKEN.match(text, self.end)
            self.end = token.end()
            if token.lastgroup != "blank":
                self.tokens.append((token.lastgroup, token.start(), token.end()))
        self.tokens.append(("end", self.end, self.end))

    def kind(self, i: int) -> str:
        return self.tokens[min(i, len(self.tokens) - 1)][0]

    def word(self, i: int) -> str:
        _, start, end = self.tokens[min(i, len(self.tokens) - 1)]
        return self.text[start:end]

    def inside(self, i: int) -> tuple[int, int]:
        """The span between the quotes of a string."""
        _, start, end = self.tokens[i]
        quote = _QUOTES.match(self.text, start)
        return quote.end(), end - len(quote[1])

    def key(self, i: int) -> str | None:
        """The name in a string, if it is one."""
        start, end = self.inside(i)
        return self.text[start:end] if _NAME.fullmatch(self.text, start, end) else None

    def target(self, i: int) -> tuple[str, int] | None:
        """A name that is assigned to at token ``i``, and where its value starts."""
        if self.kind(i) == "string":
            name, after = self.key(i), i + 1
        elif self.kind(i) == "name":
            name, after = self.word(i), i + 1
            while self.word(after) == "[" and self.kind(after + 1) == "string" and self.word(after + 2) == "]":
                name, after = self.key(after + 1), after + 3
        else:
            return None
        if not name or self.kind(after) != "operator":
            return None
        if self.word(after) == ":" and self.kind(i) == "name" and self.kind(after + 1) == "name":
            typed, depth = after + 2, 0  # name: Type<...> = value
            while self.word(typed) in "<>[]" and self.word(typed) or (depth > 0 and self.kind(typed) == "name"):
                depth += {"<": 1, "[": 1, ">": -1, "]": -1}.get(self.word(typed), 0)
                typed += 1
            if self.word(typed) == "=":
                return name, typed + 1
        return (name, after + 1) if self.word(after) in ("=", ":", ":=", "=>", "+=", "??=") else None

    def value(self, i: int) -> tuple[list[tuple[int, int] | str], int]:
        """The parts of the expression at token ``i``, and the token after it. An expression that
        isn't a concatenation of literals and names has no parts."""
        parts: list[tuple[int, int] | str] = []
        while True:
            kind, start, _ = self.tokens[min(i, len(self.tokens) - 1)]
            if kind == "string":
                low, high = self.inside(i)
                whole = _DOLLAR.fullmatch(self.text, low, high)
                parts += [m[1] for m in ([whole] if whole else _INSIDE.finditer(self.text, low, high))] or [(low, high)]
                i += 1
            elif kind == "reference":
                parts.append((_INSIDE.match(self.text, start) or _DOLLAR.match(self.text, start))[1])
                i += 1
            elif kind in ("name", "other"):
                run = _BARE.match(self.text, start)
                stop = run.end() if run else start + 1
                after = i + 1
                while after < len(self.tokens) - 1 and self.tokens[after][1] < stop:
                    after += 1
                if self.text[stop : stop + 1] in ("(", "["):
                    return [], after  # a call or a lookup
                named = _NAME.fullmatch(self.text, start, stop)
                parts.append(self.text[start:stop] if named else (start, stop))
                i = after
            else:
                return parts, i
            if self.word(i) in ("+", "..") or (self.word(i) == "." and self.kind(i + 1) == "string"):
                i += 1
            elif not (kind == "string" and self.kind(i) == "string"):
                return parts, i

    def assignments(self) -> list[Assigned]:
        found: list[Assigned] = []
        i = 0
        while i < len(self.tokens) - 1:
            if self.kind(i) == "name" and self.word(i + 1) == "(" and self.kind(i + 2) == self.kind(i + 4) == "string" and self.word(i + 3) == ",":
                if (name := self.key(i + 2)) and self.word(i + 5) == ")":  # set("name", "value")
                    found.append(Assigned(name, self.tokens[i][1], [self.inside(i + 4)]))
                i += 2
                continue
            names, at = [], i
            while target := self.target(i):
                names.append(target[0])
                i = target[1]
            if not names:
                i += 1
                continue
            parts, i = self.value(i)
            found += [Assigned(name, self.tokens[at][1], parts) for name in names]
        return found


def assignments(text: str) -> list[Assigned]:
    """What ``text`` assigns, in its order."""
    found: list[Assigned] = []
    at = 0
    while mark := _MARK.search(text, at):
        stop = text.find("\n", mark.start())
        statement = Statement(text, max(at, text.rfind("\n", at, mark.start()) + 1), len(text) if stop < 0 else stop)
        found += statement.assignments()
        at = statement.end
    if ":" in text:
        for m in _BLOCK.finditer(text):
            low, high = m.start(3), m.end(3)
            while low < high and text[low].isspace():
                low += 1
            while high > low and text[high - 1].isspace():
                high -= 1
            found.append(Assigned(m[2], m.start(), [(low, high)]))
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            if text.startswith(m[1], m.end()):
                low = m.start(2) + len(m[2]) - len(m[2].lstrip())
                found.append(Assigned(m[1], m.start(), [(low, low + len(m[2].strip()))]))
    found.sort(key=lambda x: x.at)
    for first, second in zip(found, found[1:], strict=False):  # name: KEY, value: literal
        if second.name.lower() in ("value", "val") and first.name.lower() in ("name", "key") and len(first.parts) == 1:
            part = first.parts[0]
            second.name = part if isinstance(part, str) else text[part[0] : part[1]]
            first.parts = []
    return found


def _scopes(text: str) -> tuple[list[int], list[int], list[int]]:
    """Where scopes change, the scope from there on, and of each scope the one around it (-1 for none)."""
    starts, scopes, around = [0], [0], [-1]
    if "{" not in text and "def " not in text and "class " not in text:
        return starts, scopes, around
    open_ = [(-1, 0)]  # indent of a body, or -1 for braces; scope
    for m in (_SCOPE if "def " in text or "class " in text else _BRACE).finditer(text):
        if m[0] == "}":
            while len(open_) > 1 and open_.pop()[0] >= 0:
                pass
        else:
            while m[0] != "{" and len(open_) > 1 and open_[-1][0] >= len(m[1]):
                open_.pop()
            around.append(open_[-1][1])
            open_.append((-1 if m[0] == "{" else len(m[1]), len(around) - 1))
        starts.append(m.start())
        scopes.append(open_[-1][1])
    return starts, scopes, around


def _followed(text: str, found: list[Assigned]) -> list[list[tuple[int, int]]]:
    """Of each assignment the spans of literals that reach its name."""
    starts, scopes, around = _scopes(text)
    scope = [scopes[bisect_right(starts, x.at) - 1] for x in found]
    by_name: dict[tuple[str, int], list[int]] = {}
    for i, x in enumerate(found):
        by_name.setdefault((x.name, scope[i]), []).append(i)
    names = {x.name for x in found}

    def source(name: str, i: int) -> int | None:
        at = scope[i] if name in names else -1
        while at >= 0:
            if own := by_name.get((name, at)):
                before = bisect_left(own, i)
                if before:
                    return own[before - 1]
                later = before + (own[before] == i)
                if later < len(own):
                    return own[later]
            at = around[at]
        return None

    reach: list[list[tuple[int, int]] | None] = [None] * len(found)
    for root in range(len(found)):
        stack, open_ = [root], set()
        while stack:
            i = stack[-1]
            if reach[i] is not None:
                stack.pop()
                continue
            sources = {p: source(p, i) for p in found[i].parts if isinstance(p, str)}
            waiting = [s for s in sources.values() if s is not None and reach[s] is None and s not in open_ and s != i]
            open_.add(i)
            if waiting:
                stack += waiting
                continue
            spans: dict[tuple[int, int], None] = {}
            for p in found[i].parts:
                if not isinstance(p, str):
                    spans[p] = None
                elif sources[p] is not None:
                    spans.update(dict.fromkeys(reach[sources[p]] or ()))
                elif not _PATH.match(p) and (k := text.find(p, found[i].at + 1)) >= 0 and len(found[i].parts) == 1:
                    spans[(k, k + len(p))] = None  # a bare word that no one assigns
            reach[i] = list(spans)
            stack.pop()
    return reach


def literal_score(value: str) -> int:
    """0 if ``value`` can't be a credential; more for length, mixed character classes and entropy."""
    n = len(value)
    if n < SHORTEST or " " in value or (value[0] == "<" and value[-1] == ">") or _PLACEHOLDER.match(value):
        return 0
    counts = Counter(value)
    distinct = "".join(counts)
    classes = sum(bool(re.search(c, distinct)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return 1 + (classes > 1) + (n >= 12) + (entropy > 3.0) + (entropy > 3.8)


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through names that hold them."""
    found = assignments(text)
    scores = [name_score(x.name) for x in found]
    if not any(n >= 2 for n in scores):
        return []
    spans, literals = set(), {}
    for n, held in zip(scores, _followed(text, found), strict=True):
        if n >= 2 and held:
            key = tuple(held)
            if key not in literals:
                literals[key] = literal_score(re.sub(r"[ \t]*\n[ \t]*", "", "".join(text[a:b] for a, b in held)))
            if literals[key] and n + literals[key] >= THRESHOLD:
                spans.update(held)
    return sorted((*x, "lexed") for x in spans if x[0] < x[1])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            more = lexed_spans(text) if "=" in text or ":" in text or "</" in text else []
            n = Counter(kind for _, _, kind in base)
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and n_lexed."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(tidy(_scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")
