"""Filter strings of search requests as Spark conditions.

A filter comes from a client, so it is read by a grammar of its own into columns of a fixed list of forms and
nothing else: no functions but ``array_contains``, no subqueries, no expressions of Spark's.

    filter     = and-term { ("or" | "||") and-term }
    and-term   = not-term { ("and" | "&&") not-term }
    not-term   = [ "not" | "!" ] ( "(" filter ")" | comparison )
    comparison = field ( "==" | "=" | "!=" | "<>" | "<" | "<=" | ">" | ">=" ) value
               | field [ "not" ] "in" list | field [ "not" ] "like" string | field "is" [ "not" ] "null"
               | value ( "<" | "<=" | ">" | ">=" | "==" ) field
               | "array_contains" "(" field "," value ")"
    field      = name { "." name }        list = "[" [ value { "," value } ] "]", or in round brackets

Values are numbers, strings in either quotes with backslash escapes, ``true`` and ``false``; words are of any case.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[^\W\d]\w*(?:\.[^\W\d]\w*)*)|(?P<sign>==|!=|<>|<=|>=|&&|\|\||[=<>!()\[\],]))""")
COMPARE: dict[str, Callable] = {"==": operator.eq, "=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: The same comparison with its sides exchanged.
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "=": "=", "!=": "!=", "<>": "<>"}
WORDS = {"and", "or", "not", "in", "like", "is", "null", "true", "false"}


class FilterError(ValueError):
    """A filter that the grammar does not have."""


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            found = TOKEN.match(text, at)
            if not found:
                raise FilterError(f"cannot read {text[at : at + 20]!r} in a filter")
            kind, at = found.lastgroup, found.end()
            value = found.group(kind)
            word = value.lower()
            self.tokens.append((word, word) if kind == "name" and word in WORDS else (value, value) if kind == "sign" else (kind, value))
        self.at = 0

    def peek(self, *kinds: str, ahead: int = 0) -> bool:
        return self.at + ahead < len(self.tokens) and self.tokens[self.at + ahead][0] in kinds

    def take(self, *kinds: str) -> str:
        if not self.peek(*kinds):
            raise FilterError(f"expected {' or '.join(kinds)} at place {self.at + 1} of the filter {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def either(self) -> Column:
        left = self.both()
        while self.peek("or", "||"):
            self.at += 1
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.negated()
        while self.peek("and", "&&"):
            self.at += 1
            left = left & self.negated()
        return left

    def negated(self) -> Column:
        if self.peek("not", "!"):
            self.at += 1
            return ~self.negated()
        if self.peek("("):
            self.at += 1
            inner = self.either()
            self.take(")")
            return inner
        return self.comparison()

    def comparison(self) -> Column:
        if not self.peek("name"):
            value, sign = self.value(), self.take(*COMPARE)
            return COMPARE[TURNED[sign]](self.field(), value)
        if self.tokens[self.at][1].lower() == "array_contains" and self.peek("(", ahead=1):
            self.at += 2
            column = self.field()
            self.take(",")
            value = self.value()
            self.take(")")
            return F.array_contains(column, value)
        column = self.field()
        if self.peek("is"):
            self.at += 1
            wanted = not self.peek("not")
            self.at += not wanted
            self.take("null")
            return column.isNull() if wanted else column.isNotNull()
        turned = self.peek("not")
        self.at += turned
        if self.peek("in"):
            self.at += 1
            found = column.isin(self.values())
        elif self.peek("like"):
            self.at += 1
            found = column.like(_unquoted(self.take("string")))
        elif turned:
            raise FilterError(f"expected in or like after not in the filter {self.text!r}")
        else:
            return COMPARE[self.take(*COMPARE)](column, self.value())
        return ~found if turned else found

    def field(self) -> Column:
        return F.col(".".join(f"`{part}`" for part in self.take("name").split(".")))

    def values(self) -> list:
        end = "]" if self.take("[", "(") == "[" else ")"
        out = []
        while not self.peek(end):
            out.append(self.plain())
            if not self.peek(end):
                self.take(",")
        self.take(end)
        return out

    def plain(self):
        if self.peek("true", "false"):
            return self.take("true", "false") == "true"
        if self.peek("string"):
            return _unquoted(self.take("string"))
        text = self.take("number")
        return int(text) if re.fullmatch(r"-?\d+", text) else float(text)

    def value(self) -> Column:
        return F.lit(self.plain())


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.DOTALL)


def condition(text: str | None) -> Column:
    """A request's filter as a column. An empty filter lets everything through; one that the grammar
    does not have is a ``FilterError``."""
    if not text or not text.strip():
        return F.lit(True)
    reader = _Reader(text)
    out = reader.either()
    if reader.at < len(reader.tokens):
        raise FilterError(f"nothing may follow place {reader.at} of the filter {text!r}")
    return out
