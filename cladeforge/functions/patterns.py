r"""Regular expressions written for Python, for Spark's Java engine.

A pattern is parsed by Python and written anew from its tree, so that it means the same: in
Java's own reading `\d`, `\w`, `\s` and `\b` know ASCII only, `.` and `$` know further line
ends, `\Z` is another place, and brackets nest. What letters and digits are is told by
each engine's version of Unicode.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

#: White space as Python's `\s` has it.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASSES = {
    "DIGIT": (r"\p{Nd}", "0-9"),
    "SPACE": (SPACE, r"\t-\r\x20"),
    "WORD": (r"\p{L}\p{N}_", "A-Za-z0-9_"),
}
#: What is written as one piece, which a repeat can follow. Java repeats characters and
#: classes in a loop, groups by recursion.
_WHOLE = (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN, C.SUBPATTERN, C.ATOMIC_GROUP, C.GROUPREF)


def _character(code: int) -> str:
    c = chr(code)
    return c if c == "_" or c.isascii() and c.isalnum() else rf"\x{{{code:x}}}"


def java_name(name: str) -> bool:
    """Whether Java can have a group of that name."""
    return re.fullmatch("[A-Za-z][A-Za-z0-9]*", name) is not None


class _Writer:
    def __init__(self, names: dict[str, int]):
        self.names = {number: name for name, number in names.items() if java_name(name)}

    def sequence(self, items, flags: int) -> str:
        return "".join(self.item(op, value, flags) for op, value in items)

    def item(self, op, value, flags: int) -> str:
        if op is C.LITERAL:
            return _character(value)
        if op is C.NOT_LITERAL:
            return f"[^{_character(value)}]"
        if op is C.ANY:
            return r"[\s\S]" if flags & re.DOTALL else r"[^\n]"
        if op is C.IN:
            return self.members(value, flags)
        if op is C.AT:
            return self.place(value, flags)
        if op is C.BRANCH:
            return "(?:" + "|".join(self.sequence(x, flags) for x in value[1]) + ")"
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            text = self.sequence(inner, flags)
            if len(inner) != 1 or inner[0][0] not in _WHOLE:
                text = f"(?:{text})"
            times = {(0, C.MAXREPEAT): "*", (1, C.MAXREPEAT): "+", (0, 1): "?"}.get((low, high))
            if times is None:
                times = f"{{{int(low)},{'' if high is C.MAXREPEAT else int(high)}}}"
            return text + times + {C.MAX_REPEAT: "", C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}[op]
        if op is C.SUBPATTERN:
            return self.group(*value, flags)
        if op is C.ATOMIC_GROUP:
            return f"(?>{self.sequence(value, flags)})"
        if op is C.GROUPREF:
            return rf"\k<{self.names[value]}>" if value in self.names else rf"(?:\{value})"
        if op in (C.ASSERT, C.ASSERT_NOT):
            sign = ("<" if value[0] < 0 else "") + ("=" if op is C.ASSERT else "!")
            return f"(?{sign}{self.sequence(value[1], flags)})"
        if op is C.FAILURE:
            return "(?!)"
        raise ValueError(f"no equal in Java's patterns: {str(op).lower()}")

    def group(self, number: int | None, add: int, remove: int, inner, flags: int) -> str:
        now = (flags | add) & ~remove
        if add & (re.ASCII | re.UNICODE):
            now = (now & ~(re.ASCII | re.UNICODE)) | (add & (re.ASCII | re.UNICODE))
        text = _cased(self.sequence(inner, now), now, flags)
        if number is None:
            return f"(?:{text})"
        return f"(?<{self.names[number]}>{text})" if number in self.names else f"({text})"

    def members(self, items, flags: int) -> str:
        negated = bool(items) and items[0][0] is C.NEGATE
        inside, others = "", []
        for op, value in items[1:] if negated else items:
            if op is C.LITERAL:
                inside += _character(value)
            elif op is C.RANGE:
                inside += f"{_character(value[0])}-{_character(value[1])}"
            else:
                not_in, text = self.category(value, flags)
                if not_in:
                    others.append(f"[^{text}]")
                else:
                    inside += text
        if not others:
            return f"[{'^' if negated else ''}{inside}]"
        any_of = "|".join(([f"[{inside}]"] if inside else []) + others)
        return f"(?:(?!{any_of})(?s:.))" if negated else f"(?:{any_of})"

    def category(self, value, flags: int) -> tuple[bool, str]:
        name = str(value).removeprefix("CATEGORY_")
        wide, narrow = _CLASSES[name.removeprefix("NOT_")]
        return name.startswith("NOT_"), narrow if flags & re.ASCII else wide

    def place(self, value, flags: int) -> str:
        word = f"[{_CLASSES['WORD'][bool(flags & re.ASCII)]}]"
        many = flags & re.MULTILINE
        return {
            C.AT_BEGINNING: r"(?<![^\n])" if many else r"\A",
            C.AT_BEGINNING_STRING: r"\A",
            C.AT_END: r"(?![^\n])" if many else r"(?=\n?\z)",
            C.AT_END_STRING: r"\z",
            C.AT_BOUNDARY: f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
            C.AT_NON_BOUNDARY: rf"(?:(?<={word})(?={word})|(?!\A\z)(?<!{word})(?!{word}))",
        }[value]


def _cased(text: str, flags: int, around: int) -> str:
    """text under its own rule for cases where that isn't the rule around it."""
    rule = lambda f: (bool(f & re.IGNORECASE), not f & re.ASCII) if f & re.IGNORECASE else (False, False)
    mine = rule(flags)
    if mine == rule(around):
        return text
    return {(False, False): "(?-iu:", (True, False): "(?i-u:", (True, True): "(?iu:"}[mine] + text + ")"


def java_regex(pattern: str) -> str:
    """The pattern in Java's form. Groups keep their numbers, and names that Java can have.

    Raises ValueError for what isn't a pattern, and for a choice by whether a group took
    part, the one thing that Java lacks.
    """
    try:
        compiled = re.compile(pattern)
        tree = _parser.parse(pattern)
    except re.error as wrong:
        raise ValueError(f"not a pattern: {pattern!r}: {wrong}") from wrong
    return _cased(_Writer(dict(compiled.groupindex)).sequence(tree, compiled.flags), compiled.flags, 0)


def java_literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def java_template(template: str, groups: int, names: dict[str, int] | None = None) -> str:
    """A replacement template with \\1, \\g<1>, \\g<name>; other text is taken literally.
    names: numbers of the groups that have one.

    Raises ValueError where a group doesn't exist or an escape is unknown.
    """
    names = names or {}
    simple = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b", "\\": "\\"}
    out, at = [], 0
    literal = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    for m in re.finditer(r"\\(?:g<(\w+)>|(\d{1,2})|(.)|$)", template, re.DOTALL):
        out.append(literal(template[at : m.start()]))
        at = m.end()
        name, number, escaped = m.groups()
        if name and not name.isdigit():
            if name not in names:
                raise ValueError(f"unknown group {name!r} in {template!r}")
            out.append("${" + name + "}" if java_name(name) else f"${names[name]}")
        elif name or number:
            if int(name or number) > groups:
                raise ValueError(f"invalid group reference in {template!r}")
            out.append(f"${int(name or number)}")
        elif escaped in simple:
            out.append(literal(simple[escaped]))
        elif escaped and not escaped.isascii() or escaped and not escaped.isalnum():
            out.append(literal("\\" + escaped))
        else:
            raise ValueError(f"bad escape in {template!r}")
    return "".join([*out, literal(template[at:])])
