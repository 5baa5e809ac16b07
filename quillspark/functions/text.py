"""Column functions on text: noise channel, gap marks, masks, distances, error rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import waves

INSERT_GAP, DELETE_GAP = "^", "@"
#: One code for each kind of character, and its name.
TYPE_NAMES = {
    "W": "word", "I": "inline", "C": "cite", "R": "ref",
    "w": "hyp-word", "i": "hyp-inline", "c": "hyp-cite", "r": "hyp-ref",
    "x": "hyp-word-top", "y": "hyp-word-bottom", "j": "hyp-inline-top", "k": "hyp-inline-bottom",
    "d": "hyp-cite-top", "e": "hyp-cite-bottom", "q": "hyp-ref-top", "s": "hyp-ref-bottom",
    "^": "insert", "@": "delete", " ": " ",
}
MARKS = {"inline": "↭", "cite": "↫", "ref": "↷"}
NESTED = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"


def ascii_folded(text: Column) -> Column:
    """Every code point that is no printable ASCII becomes '?'."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^ -~]", "?")


def noisy(text: Column) -> Column:
    """A deterministic OCR channel with deletions and substitutions."""
    merged = F.replace(F.replace(F.replace(text, F.lit(" the "), F.lit(" te ")), F.lit("rn"), F.lit("m")), F.lit("cl"), F.lit("d"))
    return F.translate(merged, "lO", "10")


def corrected(text: Column) -> Column:
    """A deterministic corrector that undoes part of the channel."""
    return F.replace(F.replace(text, F.lit(" te "), F.lit(" the ")), F.lit("1"), F.lit("l"))


def edit_distance(a: Column, b: Column, once: bool = False) -> Column:
    """Levenshtein distance over code points; null where a side is null.

    A pair costs the square of its edits, or where they are many that of its length over 64 (see waves). once names the column as not
    deterministic, so that filters on it do not find it again; aggregates do not take it then but from a column of its own.
    """

    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        differ = pc.fill_null(pc.not_equal(x, y), False)
        out = np.zeros(len(x), np.int32)
        out[np.flatnonzero(differ)] = waves.distances(waves.Texts.of(x.filter(differ)), waves.Texts.of(y.filter(differ)))
        return pa.array(out, mask=np.asarray(pc.or_(x.is_null(), y.is_null())))

    found = F.arrow_udf(of, "int")
    return (found.asNondeterministic() if once else found)(a, b)


def error_rate(distance: Column, reference_length: Column) -> Column:
    """100 * distance / length, with an empty reference counted as one."""
    return F.lit(100.0) * distance / F.greatest(reference_length, F.lit(1))


def improvement(before: Column, after: Column) -> Column:
    """Per cent by which a rate fell; null where it was 0 or is unknown."""
    return F.when(before != 0, F.lit(100.0) * (1 - after / before))


def strip_gaps(text: Column, *gaps: str) -> Column:
    for gap in gaps or (INSERT_GAP, DELETE_GAP):
        text = F.replace(text, F.lit(gap), F.lit(""))
    return text


def one_gap(text: Column) -> Column:
    """Both gap signs as one, for models that know one only."""
    return F.replace(text, F.lit(INSERT_GAP), F.lit(DELETE_GAP))


def leading_blank_repaired(source: Column, target: Column, types: Column) -> Column:
    """Aligned target and types as a struct, without a first blank that the target has and the source has not where lengths differ; null and error where lengths differ after that."""
    extra = (F.length(source) != F.length(target)) & target.startswith(" ") & ~source.startswith(" ")
    cut = lambda c: F.when(extra, F.substr(c, F.lit(2))).otherwise(c)
    even = F.length(source) == F.length(cut(target))
    return F.struct(F.when(even, cut(target)).alias("target"), F.when(even, cut(types)).alias("types"), (~even).alias("error"))


def label_escaped(token: Column) -> Column:
    """A token as a chart's label: control characters and backslashes escaped, and the word that charts read as their own in quotes."""
    plain = F.replace(token, F.lit("\\"), F.lit("\\\\"))
    for sign, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        plain = F.replace(plain, F.lit(sign), F.lit(f"\\{name}"))
    return F.when(token == "if", '"if"').otherwise(plain)


def clear_cell(text: Column, value: str) -> Column:
    """Empty where the whole cell equals the value; parts of cells stay."""
    return F.when(text == value, "").otherwise(text)


def mask_inline_target(text: Column, mark: str = MARKS["inline"]) -> Column:
    """$...$ becomes the mark; null where dollars do not pair."""
    odd = F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit("")))
    return F.when(odd % 2 == 0, F.regexp_replace(text, r"\$[^$]*\$", mark))


def mask_inline_prediction(text: Column, mark: str = MARKS["inline"]) -> Column:
    """As for targets, but the text up to and with a dollar that is left over goes."""
    return F.regexp_replace(F.regexp_replace(text, r"\$[^$]*\$", mark), r"(?s)^.*\$", "")


def mask_command(text: Column, command: str, mark: str) -> Column:
    r"""\command...{...}, up to three braces deep, becomes the mark; commands that begin alike count too."""
    return F.regexp_replace(text, rf"\\{command}[^{{}}]*?{NESTED}", mark)


def has_residual_command(text: Column) -> Column:
    """Whether a control sequence is left, once stars, back-ticks and dollars are taken out."""
    plain = F.translate(text, "*`$", "")
    return plain.rlike(r"\\(?:[^a-zA-Z]|[a-zA-Z]+[*=']?)")


def fill_types(types: Column) -> Column:
    """Deleted places (@) take the type of the place before, unless that is a blank; a leading single @ takes the type after it, unless that is a blank.

    Longer leading runs and runs after a blank stay as they are.
    """
    lead = F.regexp_replace(types, r"^@([^@ ])", "$1$1")
    runs = F.regexp_extract_all(lead, F.lit(r"(?s)[^@]@*|@+"), F.lit(0))
    first = lambda x: F.substring(x, 1, 1)
    return F.array_join(F.transform(runs, lambda x: F.when(first(x).isin("@", " "), x).otherwise(F.repeat(first(x), F.length(x)))), "")


def keep_by_type(text: Column, types: Column, wanted: str = " Ww") -> Column:
    """The characters of text whose type at the same place is wanted."""
    chars = F.zip_with(F.split(text, ""), F.split(types, ""), lambda c, t: F.when(F.instr(F.lit(wanted), t) > 0, c).otherwise(F.lit("")))
    return F.when(F.length(text) == F.length(types), F.when(F.length(text) == 0, "").otherwise(F.array_join(chars, "")))


def _filled(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """fill_types() on the code points of many texts one after the other."""
    codes, starts, sizes = codes.copy(), ends[:-1], np.diff(ends)
    at = starts[sizes >= 2]
    at = at[(codes[at] == 64) & (codes[at + 1] != 64) & (codes[at + 1] != 32)]
    codes[at] = codes[at + 1]
    last = np.maximum.accumulate(np.where(codes == 64, -1, np.arange(len(codes))))
    on = np.flatnonzero((codes == 64) & (last >= np.repeat(starts, sizes)))
    before = codes[last[on]]
    codes[on] = np.where(before == 32, 64, before)
    return codes


def _strings(codes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of code points as an Arrow array."""
    data = codes.tobytes() if codes.dtype == np.uint8 else codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    places = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)])[ends]
    return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(data)])


def kept_by_filled_types(types: Column, *texts: Column, wanted: str = " Ww") -> Column:
    """A struct of c0, c1, ...: each text as keep_by_type() cuts it by fill_types(types), for many rows at once in numpy."""

    def of(t: pa.Array, *every: pa.Array) -> pa.Array:
        codes = waves.Texts.of(t)
        keep = np.isin(_filled(codes.codes, codes.ends), [ord(c) for c in wanted])
        out = []
        for x in every:
            own = waves.Texts.of(x)
            fits = (own.sizes == codes.sizes) & np.asarray(pc.and_(t.is_valid(), x.is_valid()))
            some = np.flatnonzero(fits)
            mine = own if fits.all() else own.some(some)
            on = keep if fits.all() else keep[np.repeat(fits, codes.sizes)]
            cut = _strings(mine.codes[on], np.concatenate([[0], np.cumsum(on)])[mine.ends])
            place = np.cumsum(fits) - 1
            out.append(cut.take(pa.array(place, mask=~fits)).cast(pa.string()))
        return pa.StructArray.from_arrays(out, [f"c{k}" for k in range(len(out))])

    return F.arrow_udf(of, ", ".join(f"c{k} string" for k in range(len(texts))))(types, *texts)


def type_name(code: Column) -> Column:
    """The name of a type code; null for a code that is none."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair)), code)


def has_hyphen_type(types: Column) -> Column:
    return types.rlike("[cdewxyijkrqs]")


def scaled_points_to_pixels(sp: Column, factor: float = 4.0) -> Column:
    """TeX scaled points at 72 dpi to pixels, rounded half to even."""
    return F.bround(sp * F.lit(factor) / F.lit(65536 * 72.27 / 72))


def sentences(text: Column) -> Column:
    """Sentences end after a stop, exclamation or question mark that white space follows, and at line ends."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: s != "")


def clean_decoded(text: Column) -> Column:
    """Special tokens go, and what follows an end token on its line."""
    return F.regexp_replace(text, r"<START>|<PAD>|<UNK>|<END>.*", "")


def word_text(kind: Column, plain: Column, raw: Column) -> Column:
    """The text of a box: of words as it reads, of all other kinds the source."""
    return F.when(kind == "word", plain).otherwise(raw)


def thousands(value: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(value.cast("long"), 0)


def fixed_number(value: Column, decimals: int = 2) -> Column:
    """A number as written in metric files; NaN stays, null gives NaN."""
    return F.when(value.isNull() | F.isnan(value), "NaN").otherwise(F.format_string(f"%.{decimals}f", value.cast("double")))
