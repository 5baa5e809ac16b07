import pytest

from quillspark.functions.tex import latex_text
from quillspark.operators import marks

TEXTS = {
    r"\textbf{\emph{x}} y": "x y", r"\frac{a}{\sqrt[3]{b}}": "a/√(b)", r"\alpha\beta z": "αβz", r"caf\'e \'{e} \c{c} \v s": "café é ç š", r"\begin{it}a\end{it} b": "a b",
    r"\cite[see][p. 1]{k}\citep{l} ok": "<cit.><cit.> ok", "50\\% of % comment\nnext": "50% of next", r"\frac12": "1/2", r"\unknown{arg} x ``q'' a--b---c ~t": "arg x “q” a–b—c  t",
    r"$a_1$ and $$b$$": "a_1 and b", "": "", r"\footnote{see \ref{a}}": "[see <ref>]", r"[a] \sqrt{x}": "[a] √(x)", r"\textbf\alpha": "α", r"\item": "* ",
}
BROKEN = {"{open": "missing at the end", "close}": "without its opening", "$a$ and $b": "missing at the end", r"\begin{a}x\end{b}": "without its opening", r"\textbf": "missing at the end", r"\frac{a}": "missing at the end", r"{\textbf}": "an argument is missing", r"\begin x": "without a name"}


def test_latex_text():
    for source, text in TEXTS.items():
        assert latex_text(source) == (text, None), source
    for source, error in BROKEN.items():
        text, found = latex_text(source)
        assert text == source and error in found, (source, found)
    deep = "{" * 20_000 + "x" + "}" * 20_000
    assert latex_text(deep) == ("x", None) and latex_text(deep[:-1])[1]


def test_marked_words(spark):
    t = lambda s, n, kind="m": rf"\tikzmark{{{kind}{s}{n}}}"
    text = t("Start", 1) + r"\emph{a}" + t("End", 1) + t("START", 2, "M") + "{b" + t("END", 2, "M") + t("Start", 3) + "c" + t("End", 4) + t("End", 5) + "d" + t("Start", 5) + t("Start", 1) + "again" + t("End", 1)
    df = spark.createDataFrame([("x", text), ("y", None), ("z", "none")], "doc string, text string")
    got = [tuple(r) for r in marks.marked_words(df, "m").orderBy("mark_id").collect()]
    assert got == [("x", 1, r"\emph{a}", "a", None), ("x", 2, "{b", "{b", "} is missing at the end"), ("x", 3, None, None, "no end"), ("x", 4, None, None, "no start"), ("x", 5, None, None, "end before start")]


@pytest.mark.parametrize("namespace", ["", " xmlns='http://www.w3.org/1999/xhtml'"])
def test_hocr_tree(spark, namespace):
    word = lambda x, inner: f"<span class='ocrx_word' id='w' title='bbox {x} 1 {x + 9} 8; x_wconf 77'>{inner}</span>"
    page = f"""<?xml version="1.0"?><html{namespace}><body><div class='ocr_page'>
      <p class='ocr_par' id='p1' lang='eng'><span class='ocr_line' id='l1' title='bbox 0 0 9 9; baseline 0.01 -5; x_size 30.5; textangle 90'>{word(1, '<strong>bo<em>ld</em></strong>')} {word(20, '')} {word(40, 'a &amp; b')}</span>
      <span class='ocr_header' id='l2' title='bbox 0 0 9 9; x_size 12'>{word(1, 'head')}{word(1, 'head')}</span></p>
      <p class='ocr_par' id='p2'><span class='ocr_line' id='l3' title='bbox 0 0 9 9'>{word(5, 'two')}</span></p>{word(7, 'outside')}</div></body></html>"""
    big = f"<html><p class='ocr_par' id='p'><span class='ocr_line' id='l' title=''>{''.join(word(k, 'x' * 50) for k in range(30_000))}</span></p></html>"
    df = spark.createDataFrame([("a", page), ("b", "<html><p></html>"), ("c", None), ("d", ""), ("big", big)], "doc string, hocr string")
    rows = [tuple(r) for r in marks.hocr_words(df).filter("doc <> 'big'").select("par_id", "lang", "line_id", "x", "w", "conf", "textangle", "baseline0", "baseline1", "fontsize", "text").orderBy("line_id", "x").collect()]
    first = ("p1", "eng", "l1")
    assert rows == [
        (*first, 1, 9, 77, 90.0, 0.01, -5.0, 30.5, "bold"), (*first, 20, 9, 77, 90.0, 0.01, -5.0, 30.5, ""), (*first, 40, 9, 77, 90.0, 0.01, -5.0, 30.5, "a & b"),
        ("p1", "eng", "l2", 1, 9, 77, 0.0, None, None, 12.0, "head"), ("p2", None, "l3", 5, 9, 77, 0.0, None, None, None, "two"),
    ]
    assert marks.hocr_words(df).filter("doc = 'big'").count() == 30_000
    assert [r["doc"] for r in marks.hocr_tree(df).filter("error IS NOT NULL").collect()] == ["b"]
