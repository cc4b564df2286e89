"""Scopes of languages with braces: symbols with spans, calls with their callers, inheritance and imports of one file.

Tokens are read once, with a stack of open brackets. What stands between the last end of a statement and a `{` says
what the brace opens: a type, a function or a block. A call belongs to the innermost type or function that is open.
`facts.extract` runs this inside tasks, a file at a time; names are joined up over all files afterwards.

Defined cases: an empty or null text has no facts; a bracket without its partner is closed at the end of the file, or
passed over; comments, strings, templates, regular expressions and what stands outside PHP tags hold no brackets, but
code within a template's `${}` counts. A call on a result is written `().name`. Names of members are Class.member, of
PHP Class::member; functions inside functions are outer.inner. In Java and PHP `this`, `self`, `static`, `super` and
`parent` are led to the class or its parent, and Java's bare names to methods of the class; in scripts and Go callees
stand as written. A constructor is called as Class.<init>, of PHP as Class::__construct.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Tongue:
    """What differs between the languages."""

    name: str
    types: tuple[str, ...]
    joint: str = "."
    made: str = ".<init>"
    lines_end: bool = False
    leads: bool = False


SCRIPT = Tongue("script", ("class", "interface", "enum", "namespace"), lines_end=True)
JAVA = Tongue("java", ("class", "interface", "enum", "record"), leads=True)
GO = Tongue("go", ("struct", "interface"), lines_end=True)
PHP = Tongue("php", ("class", "interface", "trait", "enum"), joint="::", made="::__construct", leads=True)

#: Words that may stand before a declaration.
MODIFIERS = frozenset(
    "export default declare abstract async static public private protected final readonly sealed strictfp synchronized native override const".split()
)
#: Words before a bracket that are no call.
CONTROL = frozenset("if for while switch catch return function func typeof await async yield else do try throw new synchronized import require".split())
#: And in PHP and Go alone.
OWN_CONTROL = {
    "php": frozenset("fn foreach elseif match list array isset empty unset echo print use and or exit die declare include include_once require_once".split()),
    "go": frozenset("select range case go defer".split()),
}
#: What goes on over the end of a line, at its end or at the beginning of the next one.
GOES_ON = frozenset("= , . ( [ + - * / % => -> : | & ? ?. extends implements < && || return".split())
LEADS_ON = frozenset(". ?. ? : = => ) ] } , | & + * / % extends implements && ||".split())
#: Before a `{` these make it a value, after which the statement goes on.
VALUE = frozenset("= ( , < return : ? => -> [] import export type yield default const let var && ||".split())
JOINTS = (".", "?.", "->", "?->", "::")

STRING = r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\%s]|\\[\s\S])*\"|'(?:[^'\\%s]|\\[\s\S])*'"
REST = r"(?P<word>%s)|(?P<mark>=>|\?->|->|::|\?\.|\.\.\.|\S)"
NOTES = r"(?P<doc>/\*\*(?!/)[\s\S]*?\*/)|(?P<note>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)%s)|(?P<text>%s)|"
PLAIN = re.compile(NOTES % ("", STRING % (r"\n", r"\n")) + REST % r"[\w$]+")
TAGGED = re.compile(NOTES % (r"|\#(?!\[)[^\n]*", r"<<<\s*[\"']?(?P<here>\w+)[\"']?\n[\s\S]*?\n\s*(?P=here)\b|" + STRING % ("", "")) + r"(?P<out>\?>)|" + REST % r"[$\\\w]+")
TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
BEFORE_PATTERN = frozenset("( , = : [ ! & | ? { } ; + => return typeof && ||".split())


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    line: int
    fresh: bool
    doc: str = ""


def lexed(content: str, tongue: Tongue) -> Iterator[Token]:
    """Words, marks and texts; `fresh` is the first of its line, `doc` the comment before it."""
    pattern, line_ends = (TAGGED if tongue is PHP else PLAIN), [m.start() for m in re.finditer("\n", content)]
    templates: list[bool] = []  # for each open brace, whether a template goes on behind it
    last, last_line, doc = "", 0, ""

    def code_from(at: int) -> int:
        found = re.compile(r"<\?(?:php\b|=)?").search(content, at)
        return found.end() if found else len(content)

    def template_from(at: int) -> int:
        while m := TEMPLATE.search(content, at):
            at = m.end()
            if m[0] == "${":
                templates.append(True)
                return at
            if m[0] == "`":
                return at
        return len(content)

    pos = code_from(0) if tongue is PHP else 0
    while m := pattern.search(content, pos):
        kind, text, pos = m.lastgroup, m[0], m.end()
        if kind == "here":
            kind = "text"
        if kind == "doc":
            doc = text
        if kind in ("doc", "note"):
            continue
        if kind == "out":
            kind, text, pos = "mark", ";", code_from(pos)
        elif text == "`" and tongue is GO:
            pos, kind = (content.find("`", pos) + 1) or len(content), "text"
        elif text == "`" and tongue is SCRIPT:
            pos, kind = template_from(pos), "text"
        elif text == "{":
            templates.append(False)
        elif text == "}" and templates and templates.pop():
            pos = template_from(pos)
            continue
        elif text == "/" and tongue is SCRIPT and (not last or last in BEFORE_PATTERN) and (found := PATTERN.match(content, m.start())):
            pos, kind, text = found.end(), "text", "/"
        line = bisect_right(line_ends, m.start() - 1) + 1
        yield Token(kind, text, m.start(), line, line > last_line, doc)
        last, last_line, doc = text, bisect_right(line_ends, pos - 1) + 1, ""


@dataclass
class Item:
    """A token of a statement, or a closed bracket with all that it holds."""

    text: str
    at: int
    end: int
    word: bool = False


@dataclass
class Frame:
    opener: str
    at: int
    head: list[Item] = field(default_factory=list)
    kind: str = ""
    name: str = ""
    symbol: int | None = None
    parent: str = ""
    commas: int = 0
    call: int | None = None
    keeps: bool = True
    scope: Frame | None = None
    owner: Frame | None = None


def unmarked(head: list[Item]) -> tuple[list[int], list[Item]]:
    """Places of the annotations at a statement's beginning, and the rest."""
    marks, k = [], 0
    while k < len(head):
        if head[k].text == "@" and k + 1 < len(head) and head[k + 1].word:
            k += 1
            while k + 2 < len(head) and head[k + 1].text == "." and head[k + 2].word:
                k += 2
            marks.append(head[k].at)
            k += 1 + (k + 1 < len(head) and head[k + 1].text == "()")
        elif head[k].text == "#" and k + 1 < len(head) and head[k + 1].text == "[]":
            marks.append(head[k + 1].at + 1)
            k += 2
        else:
            break
    return marks, head[k:]


class Reading:
    """One file, read from its first token to its last."""

    def __init__(self, content: str, tongue: Tongue):
        self.content, self.tongue, self.tokens = content, tongue, list(lexed(content, tongue))
        self.control = CONTROL | OWN_CONTROL.get(tongue.name, frozenset())
        self.stack, self.head = [Frame("", -1)], []
        self.symbols: list[list] = []
        self.calls: dict[int, list] = {}
        self.inheritances: list[tuple[str, str]] = []
        self.imports: list[tuple] = []
        for i, token in enumerate(self.tokens):
            self.read(i, token)
        self.ended(len(self.tokens) - 1)
        while len(self.stack) > 1:
            self.closed(len(self.tokens) - 1)

    # --- tokens and brackets ---

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word" and not self.tokens[i].text[:1].isdigit()

    def read(self, i: int, token: Token) -> None:
        text, top = token.text, self.stack[-1]
        if self.tongue.lines_end and token.fresh and top.opener not in ("(", "[") and self.head and self.line_ended(i):
            self.ended(i - 1)
        if token.kind == "mark" and text in "([{":
            self.opened(i, text)
        elif token.kind == "mark" and text in ")]":
            while self.stack[-1].opener == "=>":
                self.stack.pop()
            if self.stack[-1].opener == {")": "(", "]": "["}[text]:
                self.closed(i)
        elif token.kind == "mark" and text == "}":
            if any(f.opener == "{" for f in self.stack):
                self.ended(i - 1)
                while self.stack[-1].opener != "{":
                    self.closed(i)
                self.closed(i)
        elif token.kind == "mark" and text == ";":
            if top.opener not in ("(", "["):
                self.ended(i)
        else:
            self.head.append(Item(text if token.kind != "text" else "''", i, i, self.word(i)))
            if text == ",":
                top.commas += 1
                if top.opener == "{" and top.keeps:
                    self.head = []  # the next entry of a value
            elif text == "=>" and self.tongue is SCRIPT and self.text(i + 1) != "{" and (found := self.declared()):
                self.declare(i, "=>", *found)
            if self.word(i):
                self.called(i)

    def line_ended(self, i: int) -> bool:
        if self.text(i - 1) in GOES_ON or self.text(i) in LEADS_ON or self.text(i) == "{" and self.tongue is SCRIPT:
            return False
        return bool(unmarked(self.head)[1])

    def opened(self, i: int, opener: str) -> None:
        found = self.declared() if opener == "{" else None
        if found:
            self.declare(i, opener, *found)
            return
        frame = Frame(opener, i, self.head, keeps=opener != "{" or self.stack[-1].opener in ("(", "[") or bool(self.head) and (self.head[-1].text in VALUE or self.head[0].text in ("use", "import", "export")))
        if opener == "(":
            frame.call = i - 1 if i - 1 in self.calls else self.generic_call(i)
        elif opener == "{" and self.tongue is not GO and len(self.head) > 1 and self.head[-1].text == "()" and self.head[-2].word:
            self.calls.pop(self.head[-2].at, None)  # a method of an object, not a call
        self.push(frame)
        self.head = []

    def closed(self, i: int) -> None:
        frame = self.stack.pop()
        if frame.symbol is not None:
            self.symbols[frame.symbol][5] = self.tokens[i].line
        if frame.call is not None and frame.call in self.calls:
            empty, trailing = i == frame.at + 1, self.text(i - 1) == ","
            self.calls[frame.call][4] = 0 if empty else frame.commas + 1 - trailing
        if frame.keeps:
            self.head = frame.head
            if frame.opener != "=>":
                self.head.append(Item({"(": "()", "[": "[]", "{": "{}"}[frame.opener], frame.at, i))
        else:
            self.head = []

    def ended(self, i: int) -> None:
        """A statement's end: what it declares without a body, embeds or imports."""
        top, (_, rest) = self.stack[-1], unmarked(self.head)
        if top.opener == "=>":
            self.stack.pop()
            self.symbols[top.symbol][5] = self.tokens[i].line
            top = self.stack[-1]
        elif rest and top.kind in TYPE_KINDS:
            texts = [x.text for x in rest]
            bodyless = self.tongue is PHP or self.tongue is JAVA or "abstract" in texts
            if bodyless and texts[0] not in ("return", "use") and (found := self.declared()):
                self.declare(i, "{", *found)
                self.stack.pop()
                self.symbols[-1][5] = self.tokens[i].line
            elif self.tongue is GO and all(x.word or x.text in ("*", ".") for x in rest) and sum(x.word for x in rest) == 1 + texts.count("."):
                self.inheritances.append((top.name, "".join(t for t in texts if t != "*")))
        elif rest and top.opener == "":
            self.imported(rest)
        self.head = []

    # --- declarations ---

    def push(self, frame: Frame) -> None:
        """Every frame knows the innermost named one and the innermost type, itself included."""
        top = self.stack[-1]
        frame.scope, frame.owner = (frame if frame.name else top.scope), (frame if frame.kind in TYPE_KINDS else top.owner)
        self.stack.append(frame)

    def scope(self) -> str:
        found = self.stack[-1].scope
        return found.name if found else ""

    def declared(self) -> tuple[str, str, Item, int, str] | None:
        """Kind, full name, item of the name, place of its parameters or -1, first parent: of the statement so far."""
        top, scope = self.stack[-1], self.scope()
        if not self.head or top.opener in ("(", "["):
            return None
        _, rest = unmarked(self.head)
        texts = [x.text for x in rest]
        if not rest:
            return None
        named = lambda name, joint=".": f"{scope}{joint}{name}" if scope else name
        k = next((n for n, w in enumerate(texts) if w not in MODIFIERS), len(texts))
        at = lambda n: rest[n] if 0 <= n < len(rest) else Item("", -1, -1)
        if self.tongue is GO:
            if texts[0] == "type" and at(1).word and texts[-1] in self.tongue.types:
                return texts[-1], named(texts[1]), rest[1], -1, ""
            group = next((n for n in range(2, len(rest)) if texts[n] == "()"), -1)
            if texts[0] == "func" and at(1).word and group > 0:
                return "function", named(texts[1]), rest[1], group, ""
            if texts[0] == "func" and at(1).text == "()" and at(2).word:
                inner = self.tokens[at(1).at + 1 : at(1).end]
                words = [t.text for t in inner[: next((n for n, t in enumerate(inner) if t.text == "["), len(inner))] if t.kind == "word"]
                return "method", f"{words[-1]}.{texts[2]}" if words else texts[2], rest[2], 3, ""
            return None
        if texts.count("<") > texts.count(">") and at(k).text in self.tongue.types:
            return None  # a brace among type arguments
        if at(k).text in self.tongue.types and at(k + 1).word and (at(k).text != "record" or at(k + 2).text in ("()", "<")):
            return at(k).text, named(texts[k + 1]), rest[k + 1], -1, ",".join(self.parents(rest[k + 2 :]))
        in_type = top.kind in TYPE_KINDS
        if at(k).text == "function":
            n = k + 1 + (at(k + 1).text in ("*", "&"))
            if at(n).word:
                kind = "method" if in_type else "function"
                return kind, named(texts[n], self.tongue.joint if in_type else "."), rest[n], n + 1, ""
        equals = texts.index("=") if "=" in texts else -1
        if self.tongue is SCRIPT and equals > 0 and (at(k).text in ("let", "var") or texts[k - 1] == "const" or in_type):
            name = at(k + (at(k).text in ("let", "var")) + (in_type and at(k).text == "#"))
            value = [t for t in texts[equals + 1 :] if t != "async"]
            arrow = value[-1:] == ["=>"] and value.count("=>") == 1 and (value[0] in ("()", "<") or len(value) == 2)
            if name.word and value and (arrow or value[0] == "function"):
                group = next((n for n in range(equals, len(rest)) if texts[n] == "()"), -1)
                return "method" if in_type else "function", named(name.text), name, group, ""
        if not in_type or self.tongue is PHP:
            return None
        group = next((n for n, w in enumerate(texts) if w == "()"), -1)
        compact = self.tongue is JAVA and group < 0 and k == len(rest) - 1 and rest[k].text == top.name.split(".")[-1]
        if compact:
            return "constructor", named(texts[k]), rest[k], -1, ""
        n, depth = group - 1, 0
        while n > 0 and (depth or texts[n] == ">"):  # over the type parameters before the bracket
            depth += (texts[n] == ">") - (texts[n] == "<")
            n -= 1
        if group < 1 or not at(n).word or texts[n] in self.control or -1 < equals < group:
            return None
        if self.tongue is JAVA:
            own = texts[n] == top.name.split(".")[-1]
            if n == 0 and not own or texts[0] == ",":
                return None  # a constant of an enum with arguments
            return "constructor" if own and n == k else "method", named(texts[n]), rest[n], group, ""
        if top.kind != "class":
            return None
        return "constructor" if texts[n] == "constructor" else "method", named(texts[n]), rest[n], group, ""

    def parents(self, rest: list[Item]) -> list[str]:
        """Names after extends and implements, without type arguments."""
        found, depth, on = [], 0, False
        for n, x in enumerate(rest):
            depth += (x.text == "<") - (x.text == ">")
            if depth or x.text == ">":
                continue
            if x.text in ("extends", "implements"):
                on = True
            elif on and x.word and (n == 0 or rest[n - 1].text != "."):
                found.append(x.text.lstrip("\\"))
            elif on and x.word:
                found[-1] += f".{x.text}"
        return found

    def declare(self, i: int, opener: str, kind: str, name: str, item: Item, group: int, parents: str) -> None:
        marks, rest = unmarked(self.head)
        self.calls.pop(item.at, None)
        first = self.tokens[rest[0].at]
        params = self.content[self.tokens[rest[group].at].start : self.tokens[rest[group].end].start + 1] if 0 <= group < len(rest) and rest[group].text == "()" else ""
        doc = self.tokens[self.head[0].at].doc or first.doc
        text = " ".join(filter(None, (part.strip(" \t*/") for part in doc.splitlines())))
        self.symbols.append([name, kind, f"{item.text}{params}" if params else "", text, self.tokens[self.head[0].at].line, self.tokens[i].line, [self.text(m) for m in marks]])
        bases = parents.split(",") if parents else []
        self.inheritances += [(name, b) for b in bases]
        self.push(Frame(opener, i, self.head if opener == "=>" else [], kind, name, len(self.symbols) - 1, bases[0] if bases else "", keeps=opener == "=>"))
        self.head = []

    # --- calls ---

    def generic_call(self, i: int) -> int | None:
        """The name before type arguments that end right before the bracket at i, now known as called."""
        k, depth = i - 1, 0
        if self.tongue not in (SCRIPT, JAVA) or self.text(k) != ">":
            return None
        while k > 0 and (depth or self.text(k) == ">"):
            depth += (self.text(k) == ">") - (self.text(k) == "<")
            if not (self.word(k) or self.text(k) in ("<", ">", ".", ",", "|", "[", "]") or self.tokens[k].kind == "text"):
                return None
            k -= 1
        if k in self.calls or not self.word(k) or self.tongue is JAVA:
            return k if k in self.calls else None
        self.called(k, True)
        return k if k in self.calls else None

    def called(self, i: int, sure: bool = False) -> None:
        text, top, before = self.text(i), self.stack[-1], self.text(i - 1)
        if before == "new" or before in JOINTS and self.made(i):
            if self.text(i) != "class" and self.text(i + 1) not in JOINTS and self.text(i + 1) != "[" and not (self.tongue is JAVA and self.text(i + 1) not in ("(", "<")):
                chain, _ = self.chain(i)
                self.add(i, chain, "constructor")
            return
        if not sure and self.text(i + 1) != "(" or text in self.control and before not in JOINTS or before in ("function", "func", "fn", "@", "class") or before in ("*", "&") and self.text(i - 2) == "function":
            return
        if top.opener == "[" and self.text(top.at - 1) == "#" or top.kind in TYPE_KINDS and not any(x.text == "=" for x in self.head):
            return
        chain, on_result = self.chain(i)
        scoped = any(self.text(i - 2 * n + 1) == "::" for n in range(1, len(chain)))
        static = scoped or len(chain) > 1 and chain[0][:1].isupper()
        self.add(i, ["()", *chain] if on_result else chain, "static_method" if static else "method" if len(chain) > 1 or on_result else "function")

    def made(self, i: int) -> bool:
        while self.text(i - 1) in JOINTS and self.word(i - 2):
            i -= 2
        return self.text(i - 1) == "new"

    def chain(self, i: int) -> tuple[list[str], bool]:
        parts = [self.text(i)]
        while self.text(i - 1) in JOINTS and self.word(i - 2):
            i -= 2
            parts.insert(0, self.text(i))
        return parts, self.text(i - 1) in JOINTS

    def add(self, i: int, parts: list[str], kind: str) -> None:
        owner, joint, made = self.stack[-1].owner, self.tongue.joint, self.tongue.made
        parts = [p.lstrip("\\") for p in parts]
        if self.tongue.leads and owner:
            lead = {"this": owner.name, "$this": owner.name, "self": owner.name, "static": owner.name, "super": owner.parent, "parent": owner.parent}.get(parts[0])
            if parts == ["super"] and lead:
                kind = "constructor"
            parts[0] = lead or parts[0]
        scoped = joint if self.tongue is PHP else "."
        callee = scoped.join(parts) + (made if kind == "constructor" else "")
        self.calls[i] = [self.scope(), callee, kind, self.tokens[i].line, 0]

    # --- imports and results ---

    def imported(self, rest: list[Item]) -> None:
        tokens = self.tokens[rest[0].at : rest[-1].end + 1]
        source = [t.text for t in tokens]
        if self.tongue is SCRIPT:
            texts = [t.text[1:-1] for t in tokens if t.kind == "text"]
            wanted = [t for t in source[1:] if t != "type"]
            if source[0] in ("const", "let", "var") and "require" in source and texts and "=" in source:
                wanted = source[1 : source.index("=")]
            elif source[0] != "import" or not texts or wanted[:1] == ["("]:
                return
            names, inside, alias, named = [], False, None, False
            for n, w in enumerate(wanted):
                if w in ("from", "=") and not inside or w[:1] in "\"'":
                    break
                inside = (inside or w == "{") and w != "}"
                named = named or w == "{"
                if not re.fullmatch(r"[\w$]+", w) or w == "as":
                    continue
                if n and wanted[n - 1] in ("as", ":") and inside and names:
                    names[-1] = (names[-1][0], w)
                elif inside:
                    names.append((w, w))
                else:
                    alias = w
            if alias or not named:
                self.imports.append((texts[-1], [], [], False, alias))
            if names:
                self.imports.append((texts[-1], [a for a, _ in names], [b for _, b in names], True, None))
        elif self.tongue is JAVA and source[0] == "import":
            parts = [w for w in source[1:] if w not in (".", "static")]
            self.imports.append((".".join(parts), [], [], False, parts[-1]) if parts[-1] != "*" else (".".join(parts[:-1]), ["*"], ["*"], True, None))
        elif self.tongue is GO and source[0] == "import":
            for n, t in enumerate(tokens):
                if t.kind == "text":
                    path, before = t.text[1:-1], tokens[n - 1]
                    alias = before.text if before.text not in ("import", "(") and before.kind != "text" and before.line == t.line else path.rsplit("/", 1)[-1]
                    self.imports.append((path, [], [], False, alias))
        elif self.tongue is PHP and source[0] == "use":
            parts = [w for w in source[1:] if w not in ("function", "const")]
            head = parts[0] if "{" in parts else ""
            for n, w in enumerate(parts):
                if re.fullmatch(r"[\\\w]+", w) and w != "as" and (n == 0 or parts[n - 1] in ("{", ",")) and not (n == 0 and head):
                    alias = parts[n + 2] if parts[n + 1 : n + 2] == ["as"] else w.rsplit("\\", 1)[-1]
                    self.imports.append(((head + w).lstrip("\\"), [], [], False, alias))

    def facts(self) -> dict:
        methods = {s[0] for s in self.symbols}
        calls = [c for _, c in sorted(self.calls.items())]
        if self.tongue is JAVA:
            for c in calls:
                owner = c[0]
                while c[2] == "function" and owner:
                    if f"{owner}.{c[1]}" in methods:
                        c[1], c[2] = f"{owner}.{c[1]}", "method"
                    owner = owner.rpartition(".")[0]
        return {"symbols": [tuple(s) for s in self.symbols], "calls": [tuple(c) for c in calls], "imports": self.imports, "inheritances": self.inheritances}


TYPE_KINDS = frozenset(t for tongue in (SCRIPT, JAVA, GO, PHP) for t in tongue.types if t != "namespace")


def brace_facts(content: str, tongue: Tongue) -> dict:
    """symbols, calls, imports and inheritances of a file, as in facts.FACTS."""
    return Reading(content, tongue).facts()
