"""Position marks in TeX and .aux text, and words of hOCR pages."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tex import latex_text

_SIDE = r"(?i:Start|End)"


def aux_positions(lines: DataFrame, kind: str) -> DataFrame:
    """mark_id, x0, y0, x1, y1 (scaled points), page0, page1 for the marks of a kind.

    lines: doc, line. A mark's line names a position, the position's own lines give its place and page; all are joined by name, so that a
    lost line drops one mark only. Kinds are found in upper case too. Marks without both ends are left out; see unpaired().
    """
    return _ends(lines, kind).filter("x0 IS NOT NULL AND x1 IS NOT NULL").select("doc", "mark_id", "x0", "y0", "x1", "y1", "page0", "page1")


def unpaired(lines: DataFrame, kind: str) -> DataFrame:
    """Marks of which one end is missing, and which."""
    return _ends(lines, kind).filter("x0 IS NULL OR x1 IS NULL").select("doc", "mark_id", F.when(F.col("x0").isNull(), "start").otherwise("end").alias("missing"))


def _ends(lines: DataFrame, kind: str) -> DataFrame:
    plain = lines.filter(~F.contains("line", F.lit("writefile")))
    name = rf"(?:{kind}|{kind.upper()})"
    named = plain.select("doc", F.regexp_extract("line", rf"{name}({_SIDE})(\d+)", 1).alias("side"), F.regexp_extract("line", rf"{name}{_SIDE}(\d+)", 1).alias("no"), F.regexp_extract("line", r"pgfid(\d+)", 1).alias("pgfid"))
    named = named.filter("side <> '' AND pgfid <> ''").select("doc", "pgfid", F.lower("side").alias("side"), F.col("no").cast("int").alias("mark_id"))
    place = r"pgfsyspdfmark\s*\{pgfid(\d+)\}\s*\{(-?\d+)\}\s*\{(-?\d+)\}"
    where = plain.select("doc", *(F.regexp_extract("line", place, k).alias(c) for k, c in ((1, "pgfid"), (2, "x"), (3, "y")))).filter("pgfid <> ''").select("doc", "pgfid", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    leaf = r"savepicturepage\s*\{pgfid(\d+)\}\s*\{(\d+)\}"
    pages = plain.select("doc", F.regexp_extract("line", leaf, 1).alias("pgfid"), F.regexp_extract("line", leaf, 2).alias("page")).filter("pgfid <> ''").select("doc", "pgfid", F.col("page").cast("int").alias("page"))
    one = named.join(where, ["doc", "pgfid"]).join(pages, ["doc", "pgfid"], "left")
    at = lambda side, c, alias: F.max(F.when(F.col("side") == side, F.col(c))).alias(alias)
    return one.groupBy("doc", "mark_id").agg(*(at(side, c, f"{c}{k}") for k, side in enumerate(("start", "end")) for c in ("x", "y", "page")))


def marked_text(texts: DataFrame, kind: str) -> DataFrame:
    r"""doc, mark_id, raw: what stands between \tikzmark{<kind>Start<n>} and its end, for all marks of a text in one pass."""
    name = rf"(?:{kind}|{kind.upper()})"
    pattern = rf"(?s)\\tikzmark\{{{name}(?i:Start)(\d+)\}}(.*?)\\tikzmark\{{{name}(?i:End)\1\}}"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("n"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("raw"))
    return texts.select("doc", F.explode(both).alias("m")).select("doc", F.col("m.n").cast("int").alias("mark_id"), F.col("m.raw").alias("raw"))


def _marked(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    pattern = re.compile(rf"\\tikzmark\{{(?:{kind}|{kind.upper()})(Start|End|START|END)(\d+)\}}")
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ends: dict[tuple[int, str], re.Match] = {}
            for m in pattern.finditer(text or ""):
                ends.setdefault((int(m[2]), m[1].lower()), m)
            for mark in sorted({n for n, _ in ends}):
                start, end = ends.get((mark, "start")), ends.get((mark, "end"))
                if start and end and start.end() <= end.start():
                    raw = text[start.end() : end.start()]
                    rows.append((doc, mark, raw, *latex_text(raw)))
                else:
                    rows.append((doc, mark, None, None, "no start" if not start else "no end" if not end else "end before start"))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc", "mark_id", "raw", "word", "error"])


def marked_words(texts: DataFrame, kind: str) -> DataFrame:
    r"""doc, mark_id, raw, word, error of every mark of a kind: what stands between its first start and its first end, and how it reads (the source itself, with an error,
    where it cannot be read). A mark without one of its ends has neither, and an error that says which. A text's marks are found in one pass."""
    return texts.select(F.col("doc").cast("string").alias("doc"), "text").mapInArrow(lambda b: _marked(b, kind), "doc string, mark_id int, raw string, word string, error string")


#: What a document needs in front so that the marks compile.
PREAMBLE = "\\usepackage{tikz}\n\\usetikzlibrary{tikzmark}\n"


def with_preamble(text: Column) -> Column:
    """The document with what the marks need before its body begins."""
    return F.replace(text, F.lit("\\begin{document}"), F.lit(PREAMBLE + "\\begin{document}"))


def _tokens(text: Column) -> Column:
    body = F.regexp_extract(text, r"(?s)\\begin\{document\}(.*)\\end\{document\}", 1)
    plain = F.regexp_replace(body, r"(?m)(?<!\\)%.*$", "")
    return F.regexp_extract_all(plain, F.lit(r"(?s)\S*?\$[^$]*\$\S*|\S+"), 0)


def segments(texts: DataFrame) -> DataFrame:
    """doc, pos, token: the words of a TeX document's body. Inline math is one word; comments go."""
    return texts.select("doc", F.posexplode(_tokens(F.col("text"))).alias("pos", "token"))


def with_marks(texts: DataFrame, kind: str) -> DataFrame:
    """The words with a position mark before and after each, numbered in order, joined again by blanks, in the row that holds the text. Texts without words have no row."""
    mark = lambda side, at: F.concat(F.lit(f"\\tikzmark{{{kind}{side}"), at.cast("string"), F.lit("}"))
    words = texts.select("doc", _tokens(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return words.select("doc", F.array_join(F.transform("words", lambda w, k: F.concat(mark("Start", k), w, mark("End", k))), " ").alias("text"))


def _field(title: Column, pattern: str, kind: str, default: str = "NULL") -> Column:
    found = F.regexp_extract(title, pattern, 1)
    return F.coalesce(F.when(found != "", found).cast(kind), F.expr(f"CAST({default} AS {kind})"))


def without_namespace(markup: Column) -> Column:
    """XML without the namespace that its first tag declares, so that names are plain."""
    return F.regexp_replace(markup, r"\sxmlns(?::\w+)?=(?:\"[^\"]*\"|'[^']*')", "")


_LINES = ("ocr_line", "ocr_textfloat", "ocr_caption", "ocr_header")
HOCR = "doc string, par_id string, lang string, line_id string, word_no int, title string, line_title string, text string, error string"


def _read_page(markup: str) -> list[tuple]:
    """(par_id, lang, line_id, title, line_title, text) of each word of a page, in order: elements of class ocrx_word under a paragraph, whatever markup is in them."""
    out, above = [], []
    wanted = None
    for event, e in ElementTree.iterparse(io.BytesIO(markup.encode()), ("start", "end")):
        if event == "start":
            above.append(e)
            if wanted is None and e.get("class") == "ocrx_word":
                wanted = e
            continue
        above.pop()
        if e is not wanted:
            continue
        wanted = None
        par = next((x for x in reversed(above) if x.get("class") == "ocr_par"), None)
        line = next((x for x in reversed(above) if x.get("class") in _LINES), None)
        if par is not None and line is not None:
            out.append((par.get("id"), par.get("lang") or par.get("{http://www.w3.org/XML/1998/namespace}lang"), line.get("id"), e.get("title") or "", line.get("title") or "", "".join(e.itertext()).strip()))
    return out


def _hocr(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc", "par_id", "lang", "line_id", "word_no", "title", "line_title", "text", "error")
    for batch in batches:
        for doc, markup in zip(batch.column("doc").to_pylist(), batch.column("hocr").to_pylist(), strict=True):
            try:
                rows = [(doc, par, lang, line, k, title, line_title, text, None) for k, (par, lang, line, title, line_title, text) in enumerate(_read_page(markup or "<none/>"))]
            except ElementTree.ParseError as e:
                rows = [(doc, *(None,) * 7, str(e))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if n == "word_no" else pa.string()) for k, n in enumerate(names)], names=list(names))


def hocr_tree(pages: DataFrame) -> DataFrame:
    """doc, par_id, lang, line_id, word_no, title, line_title, text, error: the words of hOCR pages by their places in the page's tree; of a page that is not well formed one row with its error."""
    return pages.select(F.col("doc").cast("string").alias("doc"), "hocr").mapInArrow(_hocr, HOCR)


def hocr_words(pages: DataFrame) -> DataFrame:
    """doc, par_id, lang, line_id, x, y, w, h, conf, textangle, fontsize, baseline0, baseline1, descenders, ascenders, text of each word of hOCR pages.

    Words are elements of a paragraph's lines, with all the text inside them, so that markup in a word or an empty one shifts no other.
    Missing angles are 0, missing base lines null. Equal words count once. Pages that are not well formed have none: see hocr_tree().
    """
    rows, lt = hocr_tree(pages).filter("error IS NULL"), F.col("line_title")
    box = lambda k: _field(F.col("title"), r"bbox " + r"\d+ " * k + r"(\d+)", "int")
    return rows.select(
        "doc", "par_id", "lang", "line_id", box(0).alias("x"), box(1).alias("y"), (box(2) - box(0)).alias("w"), (box(3) - box(1)).alias("h"),
        _field(F.col("title"), r"x_wconf (\d+)", "int").alias("conf"), _field(lt, r"textangle (-?[\d.]+)", "double", "0").alias("textangle"), _field(lt, r"x_size (-?[\d.]+)", "double").alias("fontsize"),
        _field(lt, r"baseline (-?[\d.]+)", "double").alias("baseline0"), _field(lt, r"baseline -?[\d.]+ (-?[\d.]+)", "double").alias("baseline1"),
        _field(lt, r"x_descenders (-?[\d.]+)", "double").alias("descenders"), _field(lt, r"x_ascenders (-?[\d.]+)", "double").alias("ascenders"), "text",
    ).distinct()


def reading_order(matches: DataFrame) -> DataFrame:
    """Rows with their place on their document's page, by mark: rank and mark stay together."""
    return matches.withColumn("place", F.row_number().over(Window.partitionBy("doc", "page").orderBy("mark_id")))
