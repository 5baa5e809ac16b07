"""Nested markup: matching brackets, commands with arguments, and types of characters."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def matching(text: str, opening: str = "(", closing: str = ")", check: bool = True) -> tuple[dict[int, int], bool]:
    """The place of each opening bracket with that of its closing one, and whether (if checked) any is left over."""
    stack, pairs, error = [], {}, False
    for i, c in enumerate(text):
        if c == opening:
            stack.append(i)
        elif c == closing:
            if stack:
                pairs[stack.pop()] = i
            else:
                error = True
    return pairs, check and (error or bool(stack))


def command_span(text: str, command: str, opening: str = "{", closing: str = "}", check: bool = True, start: int = 0) -> tuple[int, int]:
    """Begin of the first command and end after its bracket closes; (-1, -1) without command, bracket or closing, (begin, -1) where brackets do not match and that is checked."""
    begin = text.find(command, start)
    at = text.find(opening, begin) if begin >= 0 else -1
    if at < 0:
        return -1, -1
    if check and matching(text[at:], opening, closing)[1]:
        return begin, -1
    end = closing_of(text, at, opening, closing)
    return (begin, end + 1) if end >= 0 else (-1, -1)


def closing_of(text: str, at: int, opening: str = "{", closing: str = "}") -> int:
    """Where the bracket at a place closes, -1 if it does not; looks no further than there."""
    depth = 0
    for m in re.compile(f"[{re.escape(opening + closing)}]").finditer(text, at):
        depth += 1 if m[0] == opening else -1
        if not depth:
            return m.start()
    return -1


def mask_commands(text: str, command: str, mark: str) -> str:
    """Every command with its argument becomes the mark. Where a command has no closed argument, the text before it since the last one and the command go."""
    out, at = [], 0
    while (here := text.find(command, at)) >= 0:
        _, end = command_span(text, command, check=False, start=here)
        if end < 0:
            at = here + len(command)
            continue
        out += [text[at:here], mark]
        at = end
    return "".join([*out, text[at:]])


def command_span_checked(text: str, command: str, opening: str = "{", closing: str = "}") -> tuple[int, int, str | None]:
    """The first command's span, tried with checked brackets first and then without; and what is wrong: 'none' (no command), 'open' (never closed), 'uneven' (closed, but other brackets are not), or None."""
    begin, end = command_span(text, command, opening, closing)
    if begin >= 0 and end >= 0:
        return begin, end, None
    again = command_span(text, command, opening, closing, check=False)
    if again[1] >= 0:
        return *again, "uneven"
    return -1, -1, "none" if text.find(command) < 0 else "open"


#: Kinds of spans that get a code, from the strongest: what a stronger kind covers, weaker ones leave.
_COMMANDS = (("C", "\\cite"), ("R", "\\ref"))


def tag_characters(text: str) -> str:
    r"""A type code for each character: I in $...$, C and R in \cite{} and \ref{}, S for \% and \&, B in {...}, O in other \command{...}, else W.

    Codes are painted as slices of one buffer: the strong ones one over the other, each span once. Of brackets only the outermost of each
    kind are painted, since what is nested in them gets the same code, so that deep nesting costs no more than its length.
    """
    types = np.full(len(text), ord("W"), dtype=np.uint8)
    dollars = [i for i, c in enumerate(text) if c == "$"]
    for a, b in zip(dollars[::2], dollars[1::2], strict=False):
        types[a : b + 1] = ord("I")
    for code, command in _COMMANDS:
        at = 0
        while (here := text.find(command, at)) >= 0:
            _, end = command_span(text, command, check=False, start=here)
            at = max(end, here + len(command))
            if end > 0:
                types[here:end] = ord(code)
    for m in re.finditer(r"\\[%&]", text):
        if (types[m.start() : m.end()] == ord("W")).all():
            types[m.start() : m.end()] = ord("S")
    pairs, _ = matching(text, "{", "}", check=False)

    def paint(spans: list[tuple[int, int]], code: str) -> None:
        done = 0
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            if b > done:
                part = types[max(a, done) : b]
                part[part == ord("W")] = ord(code)
                done = b

    commands = []
    for a, b in pairs.items():
        begin = a
        while begin and text[begin - 1].isalpha():
            begin -= 1
        if begin and begin < a and text[begin - 1] == "\\":
            commands.append((begin - 1, b + 1))
    paint(commands, "O")
    paint([(a, b + 1) for a, b in pairs.items()], "B")
    return types.tobytes().decode("ascii")


def _text_udf(function, *columns: Column) -> Column:
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else function(x) for x in text], dtype=object)

    return F.pandas_udf(of, "string")(*columns)


def mask_commands_column(text: Column, command: str, mark: str) -> Column:
    return _text_udf(lambda x: mask_commands(x, command, mark), text)


def tag_characters_column(text: Column) -> Column:
    return _text_udf(tag_characters, text)


def command_span_column(text: Column, command: str) -> Column:
    """The first command's span as a struct of begin, stop and error, as command_span_checked() has them. Null stays null."""

    def of(texts: pd.Series) -> pd.DataFrame:
        spans = [(None, None, None) if x is None else command_span_checked(x, command) for x in texts]
        return pd.DataFrame({"begin": pd.array([a for a, _, _ in spans], "Int32"), "stop": pd.array([b for _, b, _ in spans], "Int32"), "error": pd.Series([e for *_, e in spans], dtype=object)})

    return F.pandas_udf(of, "begin int, stop int, error string")(text)


#: Control sequences and what they look like in print.
MACROS = {"\\alpha": "α", "\\beta": "β", "\\gamma": "γ", "\\delta": "δ", "\\mu": "μ", "\\sigma": "σ", "\\times": "×", "\\pm": "±", "\\%": "%", "\\&": "&", "\\_": "_", "~": " ", "``": "“", "''": "”", "--": "–"}


def plain_text(text: Column) -> Column:
    """TeX source as it reads: known signs are set, commands with one argument leave it, other control sequences and braces go."""
    for macro, sign in MACROS.items():
        text = F.replace(text, F.lit(macro), F.lit(sign))
    text = F.regexp_replace(text, r"\\[a-zA-Z]+\*?\{([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"\\[a-zA-Z]+\*?\s?", ""), r"[{}]", "")
