"""TeX source as it reads: one scan with a stack of groups, environments and commands that wait for their arguments."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control sequences and the signs that they set.
SIGNS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ϵ", "lambda": "λ", "mu": "μ", "nu": "ν", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "ϕ", "chi": "χ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Lambda": "Λ", "Sigma": "Σ", "Phi": "Φ", "Omega": "Ω",
    "times": "×", "pm": "±", "cdot": "·", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "sim": "∼", "infty": "∞", "odot": "⊙", "rightarrow": "→", "ldots": "…", "dots": "…",
    "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı",
    "%": "%", "&": "&", "_": "_", "#": "#", "$": "$", "{": "{", "}": "}", ",": " ", ";": " ", " ": " ", "\\": "\n", "-": "", "/": "", "!": "",
}
#: Accents and the combining signs that follow a letter.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "r": "\u030a", "k": "\u0328"}
#: Commands by name: the kinds of their arguments (o in brackets, if there; m in braces, or the next sign) and what they print of them.
COMMANDS = (
    {name: ("m", "{0}") for name in ("textbf", "textit", "textrm", "textsf", "texttt", "textsc", "textsl", "text", "emph", "underline", "mathrm", "mathbf", "mathit", "mathcal", "mbox", "hbox", "title", "author", "section", "subsection", "caption", "footnotesize")}
    | {name: ("oom", "<cit.>") for name in ("cite", "citep", "citet", "citealt", "citeauthor", "citeyear")}
    | {name: ("m", "<ref>") for name in ("ref", "eqref", "pageref")}
    | {name: ("m", "") for name in ("label", "vspace", "hspace", "tikzmark", "bibliographystyle", "pagestyle")}
    | {"frac": ("mm", "{0}/{1}"), "sqrt": ("om", "√({1})"), "footnote": ("om", "[{1}]"), "href": ("mm", "{1}"), "url": ("m", "<{0}>"), "includegraphics": ("om", "< g r a p h i c s >"), "item": ("o", "* "), "textcolor": ("mm", "{1}")}
)
_CONTROL = re.compile(r"\\([a-zA-Z]+\*?|.|$)", re.DOTALL)
_PLAIN = re.compile(r"[^\\{}\[\]$%~`'\-]+")
_NAME = re.compile(r"\s*\{([^{}]*)\}")
#: Runs of signs that are set as one.
_RUNS = (("---", "—"), ("--", "–"), ("``", "“"), ("''", "”"))


class Broken(Exception):
    """Source whose groups, environments or arguments do not fit."""


@dataclass
class Frame:
    """What is open: a group (closed by a brace or bracket), math, an environment, the whole text, or a command that waits for arguments."""

    close: str
    parts: list[str] = field(default_factory=list)
    kinds: str = ""
    form: str = ""
    accent: str = ""


class Scan:
    def __init__(self, source: str):
        self.source, self.at, self.open = source, 0, [Frame("end")]

    def give(self, text: str) -> None:
        """Adds text to what is open; a command that has its last argument is printed into what it stands in."""
        while True:
            top = self.open[-1]
            top.parts.append(text)
            if top.close != "call" or len(top.parts) < len(top.kinds):
                return
            self.open.pop()
            text = unicodedata.normalize("NFC", top.parts[0][:1] + top.accent + top.parts[0][1:]) if top.accent else top.form.format(*top.parts)

    def call(self, kinds: str, form: str, accent: str = "") -> None:
        self.open.append(Frame("call", [], kinds, form, accent))

    def closed(self, close: str) -> None:
        if self.open[-1].close != close:
            raise Broken(f"{close} without its opening at {self.at}")
        self.give_popped()

    def give_popped(self) -> None:
        self.give("".join(self.open.pop().parts))

    def argument(self) -> bool:
        """Whether a waiting command's next argument has been opened or left out."""
        top, text = self.open[-1], self.source
        while self.at < len(text) and text[self.at].isspace():
            self.at += 1
        here = text[self.at : self.at + 1]
        if top.kinds[len(top.parts)] == "o":
            if here == "[":
                self.at += 1
                self.open.append(Frame("]"))
            else:
                self.give("")
            return True
        if here in ("", "}", "]"):
            raise Broken(f"an argument is missing at {self.at}")
        return False

    def control(self) -> None:
        m = _CONTROL.match(self.source, self.at)
        name, self.at = m[1], m.end()
        plain = name.rstrip("*") if len(name) > 1 else name
        if plain in ("begin", "end"):
            kind = _NAME.match(self.source, self.at)
            if not kind:
                raise Broken(f"an environment without a name at {self.at}")
            self.at = kind.end()
            if plain == "begin":
                self.open.append(Frame(f"\\end{{{kind[1]}}}"))
            else:
                self.closed(f"\\end{{{kind[1]}}}")
        elif plain in ACCENTS and not (plain.isalpha() and self.source[self.at : self.at + 1] not in ("{", " ")):
            self.call("m", "", ACCENTS[plain])
        elif plain in SIGNS:
            if plain.isalpha():
                self.skip_blank()
            self.give(SIGNS[plain])
        elif plain in ("(", ")", "[", "]"):
            self.give("")
        elif plain in COMMANDS:
            self.call(*COMMANDS[plain])
        else:
            # an unknown command prints nothing of its own; groups after it are read as they are
            self.skip_blank()
            self.give("")

    def skip_blank(self) -> None:
        if self.source[self.at : self.at + 1] == " ":
            self.at += 1

    def run(self) -> str:
        text = self.source
        while self.at < len(text):
            top = self.open[-1]
            waits = top.close == "call"
            if waits and self.argument():
                continue
            c = text[self.at]
            if c == "\\":
                self.control()
                continue
            if not waits and (m := _PLAIN.match(text, self.at)):
                self.at = m.end()
                self.give(m[0])
                continue
            run = next(((a, b) for a, b in _RUNS if text.startswith(a, self.at)), None)
            self.at += len(run[0]) if run else 1
            if run:
                self.give(run[1])
            elif c == "{":
                self.open.append(Frame("}"))
            elif c == "}" or c == "]" and top.close == "]":
                self.closed(c)
            elif c == "$":
                double = text.startswith("$", self.at)
                self.at += double
                if top.close == "$":
                    self.give_popped()
                else:
                    self.open.append(Frame("$"))
            elif c == "%":
                end = text.find("\n", self.at)
                self.at = len(text) if end < 0 else end + 1
            else:
                self.give(" " if c == "~" else c)
        while self.open[-1].close == "call" and set(self.open[-1].kinds[len(self.open[-1].parts) :]) == {"o"}:
            self.give("")
        if len(self.open) > 1:
            raise Broken(f"{self.open[-1].close if self.open[-1].close != 'call' else 'an argument'} is missing at the end")
        return "".join(self.open[0].parts)


def latex_text(source: str) -> tuple[str, str | None]:
    """The text that source sets, and None; or the source as it is and what is wrong with it, where its brackets, math, environments or arguments do not fit."""
    try:
        return Scan(source).run(), None
    except Broken as e:
        return source, str(e)


def latex_column(source: Column) -> Column:
    """A struct of text and error, as latex_text() has them; both null for null."""

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else latex_text(x) for x in texts], columns=["text", "error"], dtype=object)

    return F.pandas_udf(of, "text string, error string")(source)
