"""Patterns of the advanced POSIX dialect as Java patterns that match the same texts.

Only whether a text matches is asked, so that greediness does not matter. What differs:
``.`` takes line ends, ``$`` is the very end, ``\\b`` is a backspace and ``\\m \\M \\y \\Y``
are word limits, brackets have named classes and few escapes, options stand at the very
beginning. What has no meaning in the dialect is an error, as it is there; the basic
dialect and collating elements of several characters are refused.
"""

from __future__ import annotations

import re
from functools import lru_cache

# What the named classes of the dialect stand for, as members of a Java class.
CLASSES = {
    "alnum": r"\p{IsAlphabetic}\p{IsDigit}",
    "alpha": r"\p{IsAlphabetic}",
    "ascii": r"\x00-\x7F",
    "blank": r" \t",
    "cntrl": r"\p{IsControl}",
    "digit": r"0-9",
    "graph": r"\p{IsAlphabetic}\p{IsDigit}\p{IsPunctuation}\p{S}",
    "lower": r"\p{IsLowercase}",
    "print": r"\p{IsAlphabetic}\p{IsDigit}\p{IsPunctuation}\p{S}\p{Zs}",
    "punct": r"\p{IsPunctuation}\p{S}",
    "space": r"\p{IsWhite_Space}",
    "upper": r"\p{IsUppercase}",
    "word": r"\p{IsAlphabetic}\p{IsDigit}_",
    "xdigit": r"0-9A-Fa-f",
}
_SHORT = {"d": "digit", "s": "space", "w": "word"}
_CHARS = {"a": 7, "b": 8, "B": 92, "e": 27, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
_WORD = f"[{CLASSES['word']}]"
_LIMITS = {
    "A": r"\A",
    "Z": r"\z",
    "m": f"(?:(?<!{_WORD})(?={_WORD}))",
    "M": f"(?:(?<={_WORD})(?!{_WORD}))",
    "y": f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))",
    "Y": f"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))",
}
#: The largest number of a bound.
_MOST = 255


def _literal(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:X}}}"


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.lines_dot = self.lines_edge = self.spaced = self.fold = self.extended = False
        self.groups = self.depth = 0
        self.closed: set[int] = set()

    def fail(self, why: str) -> ValueError:
        return ValueError(f"bad pattern {self.text!r} at character {self.at + 1}: {why}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        if len(out) < n:
            raise self.fail("it ends too early")
        self.at += n
        return out

    def whole(self) -> str:
        if self.peek(4) == "***=":
            self.at = 4
            return self._plain()
        if self.peek(4) == "***:":
            self.at = 4
        elif self.peek(3) == "***":
            raise self.fail("*** goes with = or :")
        options = re.compile(r"\(\?([a-z]+)\)").match(self.text, self.at)
        if options:
            self.at = options.end()
            for c in options[1]:
                if c == "q":
                    return self._plain()
                if c in "nmpw":
                    self.lines_dot, self.lines_edge = c in "nmp", c in "nmw"
                elif c == "s":
                    self.lines_dot = self.lines_edge = False
                elif c in "ic":
                    self.fold = c == "i"
                elif c in "xt":
                    self.spaced = c == "x"
                elif c == "e":
                    self.extended = True
                else:
                    raise self.fail(f"option {c} is not supported")
        body = self.branches()
        if self.at < len(self.text):
            raise self.fail("a closing parenthesis has no partner")
        return ("(?iu)" if self.fold else "") + body

    def _plain(self) -> str:
        rest = self.text[self.at :]
        self.at = len(self.text)
        return ("(?iu)" if self.fold else "") + "".join(_literal(ord(c)) for c in rest)

    def _skip(self) -> None:
        """White space and remarks, where they do not count."""
        while self.spaced and self.peek():
            if self.peek().isspace():
                self.at += 1
            elif self.peek() == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end + 1
            else:
                return
        while self.peek(3) == "(?#":
            end = self.text.find(")", self.at)
            if end < 0:
                raise self.fail("a remark has no end")
            self.at = end + 1
            if self.spaced:
                self._skip()

    def branches(self) -> str:
        out = []
        self.depth += 1
        while True:
            out.append(self.branch())
            if self.peek() != "|":
                self.depth -= 1
                return "|".join(out)
            self.at += 1

    def branch(self) -> str:
        out = []
        while True:
            self._skip()
            c = self.peek()
            if not c or c == "|" or (c == ")" and (self.depth > 1 or not self.extended)):
                return "".join(out)
            atom, may_repeat = self.atom()
            self._skip()
            times = self.quantifier()
            if times and not may_repeat:
                raise self.fail("there is nothing to repeat")
            out.append(atom + times)

    def quantifier(self) -> str:
        c = self.peek()
        if c and c in "*+?":
            self.at += 1
            out = c
        elif c == "{" and self.peek(2)[1:].isdigit():
            found = re.compile(r"\{([0-9]+)(?:(,)([0-9]*))?\}").match(self.text, self.at)
            if not found:
                raise self.fail("a bound has no end")
            low, high = int(found[1]), int(found[3]) if found[3] else int(found[1])
            if low > _MOST or high > _MOST or (found[3] and low > high):
                raise self.fail("a bound is out of range")
            self.at = found.end()
            out = found[0]
        else:
            return ""
        if self.peek() == "?" and not self.extended:
            self.at += 1  # fewest first: the same texts match
        self._skip()
        after = self.peek()
        if after and after in "*+?" or (after == "{" and self.peek(2)[1:].isdigit()):
            raise self.fail("a repetition cannot be repeated")
        return out

    def atom(self) -> tuple[str, bool]:
        """(Java text of one unit, whether it can be repeated)."""
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket()
        if c == ".":
            return (r"[^\n]" if self.lines_dot else r"(?s:.)"), True
        if c == "^":
            return (r"(?<![^\n])" if self.lines_edge else r"\A"), False
        if c == "$":
            return (r"(?![^\n])" if self.lines_edge else r"\z"), False
        if c in "*+?" or (c == "{" and self.peek().isdigit()):
            raise self.fail("there is nothing to repeat")
        if c == "\\":
            return self.escape()
        return _literal(ord(c)), True

    def group(self) -> tuple[str, bool]:
        kinds = {"?:": "(?:", "?=": "(?=", "?!": "(?!", "?<=": "(?<=", "?<!": "(?<!"}
        kind = next((k for k in ("?<=", "?<!", "?:", "?=", "?!") if self.peek(len(k)) == k), None)
        if kind and not self.extended:
            self.at += len(kind)
            opened, number = kinds[kind], 0
        elif self.peek() == "?":
            raise self.fail("this kind of group is not known")
        else:
            self.groups += 1
            opened, number = "(", self.groups
        body = self.branches()
        if self.peek() != ")":
            raise self.fail("a parenthesis is not closed")
        self.at += 1
        self.closed.add(number)
        return f"{opened}{body})", kind in (None, "?:")

    def escape(self) -> tuple[str, bool]:
        c = self.take()
        if self.extended or not c.isalnum() or not c.isascii():
            return _literal(ord(c)), True
        if c.lower() in _SHORT:
            members = CLASSES[_SHORT[c.lower()]]
            line = r"\n" if c.isupper() and self.lines_dot else ""
            return f"[{'^' if c.isupper() else ''}{members}{line}]", True
        if c in _LIMITS:
            return _LIMITS[c], False
        if c.isdigit() and c != "0":
            digits = re.compile(r"[0-9]+").match(self.text, self.at - 1)[0]
            if len(digits) == 1 or int(digits) <= self.groups:
                self.at += len(digits) - 1
                if int(digits) not in self.closed:
                    raise self.fail("there is no such group yet")
                return f"(?:\\{int(digits)})", True
        return _literal(self.character(c)), True

    def character(self, c: str) -> int:
        """The code of a character escape whose first character was taken."""
        if c in _CHARS:
            return _CHARS[c]
        if c == "c":
            return ord(self.take()) & 31
        if c in "uU":
            digits = self.take(4 if c == "u" else 8)
        elif c == "x":
            digits = re.compile(r"[0-9A-Fa-f]*").match(self.text, self.at)[0]
            self.at += len(digits)
        elif c.isdigit():
            digits = re.compile(r"[0-7]{1,3}").match(self.text, self.at - 1)
            if not digits:
                raise self.fail("not an octal number")
            self.at += len(digits[0]) - 1
            return int(digits[0], 8)
        else:
            raise self.fail(f"\\{c} has no meaning")
        if not re.fullmatch(r"[0-9A-Fa-f]+", digits) or not 0 < int(digits, 16) <= 0x10FFFF:
            raise self.fail("not a character number")
        return int(digits, 16)

    def bracket(self) -> tuple[str, bool]:
        for text, limit in (("[:<:]]", "m"), ("[:>:]]", "M")):
            if self.peek(len(text)) == text:
                self.at += len(text)
                return _LIMITS[limit], False
        negated = self.peek() == "^"
        self.at += negated
        out, first = [], True
        while first or self.peek() != "]":
            member, single = self.member(first)
            first = False
            if self.peek() == "-" and self.peek(2) not in ("-", "-]"):
                if single is None:
                    raise self.fail("a class cannot begin a range")
                self.at += 1
                _, last = self.member(True)
                if last is None or last < single:
                    raise self.fail("a range has no sense")
                member = f"{_literal(single)}-{_literal(last)}"
            out.append(member)
        self.at += 1
        if negated and self.lines_dot:
            out.append(r"\n")
        return f"[{'^' if negated else ''}{''.join(out)}]", True

    def member(self, first: bool) -> tuple[str, int | None]:
        """(Java text, code of a single character) of the next member of a bracket."""
        c = self.take()
        if c == "[" and self.peek() and self.peek() in ":=.":
            kind = self.take()
            end = self.text.find(f"{kind}]", self.at)
            if end < 0:
                raise self.fail("a class has no end")
            name = self.text[self.at : end]
            self.at = end + 2
            if kind == ":":
                if name not in CLASSES:
                    raise self.fail(f"no class {name}")
                return CLASSES[name], None
            if len(name) != 1:
                raise self.fail("collating elements of several characters are not supported")
            return _literal(ord(name)), ord(name)
        if c == "\\" and not self.extended:
            c = self.take()
            if c in _SHORT:
                return CLASSES[_SHORT[c]], None
            if c.isalnum() and c.isascii():
                if c in _LIMITS or c.isupper() and c not in "BU":
                    raise self.fail(f"\\{c} has no meaning in a bracket")
                code = self.character(c)
                return _literal(code), code
        elif c == "-" and not first and self.peek() != "]" and self.peek(2)[1:] != "":
            raise self.fail("a range has no sense")
        return _literal(ord(c)), ord(c)


@lru_cache(maxsize=256)
def java_pattern(text: str) -> str:
    """The Java pattern that finds what ``text`` finds; ValueError for what the dialect does not allow."""
    return _Reader(text).whole()
