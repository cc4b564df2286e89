"""SQL statements read by tokens: what they declare, drop and write. One text at a time, inside tasks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

#: Characters after a column list, and of a SET clause, that belong to a statement. Statements inside strings of a host
#: language have no end of their own. Fixed values.
STATEMENT_CHARS, CLAUSE_CHARS = 800, 400
CLAUSE_ENDS = ("WHERE", "RETURNING", "FROM")
TOKEN = re.compile(r"(?P<stop>'''|\"\"\")|'(?P<text>[^']*)'|(?P<word>\w[\w.]*)|(?P<mark>[^\w\s\"`])")


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.value.upper() if self.kind == "word" else self.value if self.kind == "mark" else ""


NONE = Token("none", "", -1, -1)


def tokens_from(text: str, start: int, end: int | None = None) -> Iterator[Token]:
    return (Token(m.lastgroup, m[m.lastgroup], m.start(), m.end()) for m in TOKEN.finditer(text, start, len(text) if end is None else end))


class Tokens(list):
    """Tokens of a text from `start` to `end`; beyond its ends there is none, and what goes on beyond the end is left out."""

    def __init__(self, text: str, start: int = 0, end: int | None = None):
        super().__init__()
        end = len(text) if end is None else min(end, len(text))
        for t in tokens_from(text, start, end):
            if end < len(text) and (t.end == end and t.kind == "word" or t.value == "'"):
                return
            self.append(t)

    def at(self, i: int) -> Token:
        return self[i] if 0 <= i < len(self) else NONE

    def follows(self, i: int, *words: str) -> bool:
        return all(self.at(i + k).upper == w for k, w in enumerate(words))

    def past(self, i: int, *words: str) -> int:
        """The first place from i on that holds none of the words."""
        while self.at(i).upper in words:
            i += 1
        return i

    def literals(self, i: int) -> tuple[list[str], int]:
        """The literals of a list that opens at i and holds nothing else, and the place after it; no literals if it holds other things."""
        found, k = [], i + 1
        while self.at(k).kind == "text" or self.at(k).upper == ",":
            found += [self[k].value] if self[k].kind == "text" else []
            k += 1
        return (found, k + 1) if self.at(i).upper == "(" and self.at(k).upper == ")" else ([], i)

    def items(self, i: int) -> tuple[list[list[Token]], int]:
        """The items of a bracketed list that opens at i, inner brackets kept whole, and the place after it."""
        items, depth, k = [[]], 0, i
        while k < len(self):
            here = self[k].upper
            depth += (here == "(") - (here == ")")
            if depth == 0:
                return [x for x in items if x], k + 1
            if here == "," and depth == 1:
                items.append([])
            elif k > i:
                items[-1].append(self[k])
            k += 1
        return [], len(self)


def lines_of(text: str) -> Callable[[int], int]:
    breaks = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_left(breaks, at) + 1


def defaulted(tokens: Tokens, i: int, line: Callable[[int], int]) -> str:
    """The column whose definition, from its line's first word on, has the DEFAULT at i; none if brackets or commas stand between."""
    k = i
    while k > 0 and line(tokens[k - 1].start) == line(tokens[i].start):
        k -= 1
    if tokens.follows(k, "ADD", "COLUMN") or tokens.follows(k, "ALTER", "COLUMN"):
        k = tokens.past(k + 2, "IF", "NOT", "EXISTS")
    plain = k < i and tokens[k].kind == "word" and all(t.upper not in (",", ";", "(", ")") for t in tokens[k:i])
    return tokens[k].value if plain else ""


def schema_events(text: str) -> Iterator[dict]:
    """check, default, enum, drop_table and drop_column events. Constraints belong to the nearest CREATE or ALTER TABLE before them; one after a DROP CONSTRAINT of the same statement replaces what was."""
    tokens, line = Tokens(text), lines_of(text)
    owner, owner_at, dropped = "", -1, False

    def event(kind: str, i: int, end: int, table: str, column: str = "", values: list[str] | None = None, replace: bool = False) -> dict:
        start, stop = tokens[i].start, tokens[max(i, end - 1)].end
        return {"event": kind, "table": table, "column": column, "values": values or [], "is_replace": replace, "owner_at": owner_at, "position": start, "line_start": line(start), "line_end": line(stop - 1)}

    for i, t in enumerate(tokens):
        word = t.upper
        if word in ("CREATE", "ALTER", "DROP") and tokens.follows(i + 1, "TABLE"):
            k = tokens.past(i + 2, "IF", "NOT", "EXISTS")
            if tokens.at(k).kind != "word":
                continue
            if word == "DROP":
                yield event("drop_table", i, k + 1, tokens[k].value)
            else:
                owner, owner_at, dropped = tokens[k].value, t.start, False
        elif word == "DROP" and tokens.follows(i + 1, "COLUMN"):
            k = tokens.past(i + 2, "IF", "EXISTS")
            if tokens.at(k).kind == "word":
                yield event("drop_column", i, k + 1, owner, tokens[k].value)
        elif word == "DROP" and tokens.follows(i + 1, "CONSTRAINT"):
            dropped = True
        elif word == "IN" and tokens.at(i - 1).kind == "word":
            values, end = tokens.literals(i + 1)
            if values:
                yield event("check", i - 1, end, owner, tokens[i - 1].value, values, dropped)
        elif word == "DEFAULT" and tokens.at(i + 1).kind == "text" and tokens[i + 1].value:
            column = defaulted(tokens, i, line)
            if column:
                yield event("default", i, i + 2, owner, column, [tokens[i + 1].value])
        elif word == "CREATE" and tokens.follows(i + 1, "TYPE") and tokens.follows(i + 3, "AS", "ENUM"):
            values, end = tokens.literals(i + 5)
            if values:
                yield event("enum", i, end, "", tokens[i + 2].value, values)


def assigned(text: str, table: str, at: int) -> Iterator[tuple[str, str, str, int]]:
    """Literals of the SET clause that begins at `at`."""
    tokens = Tokens(text, at, at + CLAUSE_CHARS)
    for i, t in enumerate(tokens):
        if t.upper in (*CLAUSE_ENDS, ";") or t.kind == "stop":
            return
        if t.kind == "word" and tokens.follows(i + 1, "=") and tokens.at(i + 2).kind == "text":
            yield table, t.value.split(".")[-1], tokens[i + 2].value, t.start


def column_list(text: str, at: int) -> tuple[str, list[str], int] | None:
    """The table, its columns and where their list ends, of what follows INSERT INTO; None if it is no bracketed list of names. A list is as long as it is."""
    tokens, names, before = tokens_from(text, at), [], "("
    table, opening = next(tokens, NONE), next(tokens, NONE)
    if opening.upper != "(":
        return None
    for t in tokens:
        if t.upper == ")":
            return (table.value, names, t.end) if names else None
        if t.kind != "word" and t.upper != ",":
            return None
        names += [t.value] if t.kind == "word" and before in ("(", ",") else []
        before = t.upper
    return None


def written_literals(text: str) -> Iterator[tuple[str, str, str, int]]:
    """table, column, value, position of literals in INSERT tuples, ON CONFLICT assignments and UPDATE assignments."""
    for head in re.finditer(r"\b(?:insert\s+into|update)\b", text, re.I):
        if head[0].upper() == "UPDATE":
            tokens = tokens_from(text, head.end())
            table, word = next(tokens, NONE), next(tokens, NONE)
            if table.kind == "word" and word.upper == "SET":
                yield from assigned(text, table.value, word.end)
            continue
        listed = column_list(text, head.end())
        if listed is None:
            continue
        table, names, end = listed
        tokens, k = Tokens(text, end, end + STATEMENT_CHARS), 0
        while k < len(tokens) and not tokens.follows(k, "VALUES", "("):
            k += 1
        k += 1
        while tokens.follows(k, "("):
            start, (items, k) = tokens[k].start, tokens.items(k)
            if len(items) == len(names):
                yield from ((table, c, x[0].value, start) for c, x in zip(names, items, strict=True) if len(x) == 1 and x[0].kind == "text")
            k += tokens.follows(k, ",", "(")
        for i in range(len(tokens)):
            if tokens.follows(i, "DO", "UPDATE", "SET"):
                yield from assigned(text, table, tokens[i + 2].end)
                break
