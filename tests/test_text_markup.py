from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from pagetide.functions import markup, text

HOSTILE = (
    "<p>Bonjour<!-- cache --></p><script>alert('x')</script><img src=x onerror='alert(1)'>"
    "<a href='javascript:alert(2)'>clic</a><a href=' JaVa\tscript:alert(3)'>clac</a>"
    "<iframe src='https://evil.example'></iframe><div style='position:fixed'>bloc</div>"
    "<svg><style>p{}</style></svg><p onclick=alert(4)>fin"
)


def column(spark, values, use):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [row["x"] for row in frame.select("i", use(F.col("v")).alias("x")).orderBy("i").collect()]


def test_double_escapes(spark):
    cases = {
        "&amp;eacute;": "&eacute;",
        "&amp;#233;": "&#233;",
        "&amp;#x00E9;": "&#x00E9;",
        "&amp;amp;eacute;": "&eacute;",
        "Fnac &amp; Darty": "Fnac &amp; Darty",
        "&amp;lt;script&amp;gt;": "&lt;script&gt;",
        "plain": "plain",
    }
    assert column(spark, cases, text.fix_double_escaping) == list(cases.values())


def test_white_space_is_what_python_strips(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    values = [f"{b}a{b}{b}b{b}" for b in blanks] + ["  a \n\t b  ", "", "   "]
    wanted = [re.sub(r"\s+", " ", v).strip() for v in values]
    assert column(spark, values, text.normalize_ws) == wanted
    assert column(spark, values, text.trim_ws) == [v.strip() for v in values]


def test_titles(spark):
    values = ["  Cybers&amp;eacute;curit&amp;eacute;\n  renforc&eacute;e ", "A &lt;b&gt; &amp;amp;amp; c", None, ""]
    assert column(spark, values, text.clean_title) == ["Cybersécurité renforcée", "A <b> & c", None, ""]


def test_content_hash(spark):
    frame = spark.createDataFrame(
        [("Titre", "resume"), ("  Titre ", "resume\n"), ("Titre", "autre"), ("ab", "c"), ("a", "bc"), ("t", None)],
        "t string, s string",
    )
    got = [r["h"] for r in frame.select(text.content_hash(F.col("t"), F.col("s")).alias("h")).collect()]
    assert got[0] == got[1] == hashlib.sha256(b"Titre\x1fresume").hexdigest()
    assert got[0] != got[2] and got[3] != got[4]
    assert got[5] == hashlib.sha256(b"t\x1f").hexdigest()


def test_hostile_markup_is_inert(spark):
    (clean,) = column(spark, [HOSTILE], markup.sanitize)
    assert "Bonjour" in clean and "bloc" in clean and "fin" in clean
    for forbidden in ("<script", "alert(", "onerror", "onclick", "<!--", "cache", "<img", "<iframe", "javascript", "<style", "<div"):
        assert forbidden not in clean.lower()
    assert clean.count("<p>") == clean.count("</p>")


def test_allowed_markup_survives(spark):
    (clean,) = column(spark, ['<p>Voir <a href="https://example.com/a?x=1&y=2" class=k>la "source"</a>.</p>'], markup.sanitize)
    assert clean == (
        '<p>Voir <a href="https://example.com/a?x=1&amp;y=2" rel="noopener noreferrer nofollow">la "source"</a>.</p>'
    )


def test_nothing_visible_is_null(spark):
    values = [None, "", "   \n ", "<script>alert(1)</script>", "<p>   </p>", "<p>&nbsp;</p>", "<script>never closed"]
    assert column(spark, values, markup.sanitize) == [None] * len(values)


def test_escaped_tags_stay_text(spark):
    (clean,) = column(spark, ["<p>&amp;lt;script&amp;gt;alert(1)&amp;lt;/script&amp;gt;</p>"], markup.sanitize)
    assert "<script" not in clean.lower()


def test_plain_text_and_markup_paths_agree(spark):
    """Text that skips the parser must come out as the parser would write it."""
    values = ["a > b", "  x y ", "simple text"]
    with_parser = column(spark, [v + "<b></b>" for v in values], markup.sanitize)
    without = column(spark, values, markup.sanitize)
    assert [w.replace("<b></b>", "").strip() for w in with_parser] == without


def test_paragraphs_and_items_close_implicitly(spark):
    values = ["<p>a<p>b", "<ul><li>x<li>y</ul>", "<p>a<div>b</div>", "a<br>b", "<b>a<i>b</b>c"]
    wanted = ["<p>a</p><p>b</p>", "<ul><li>x</li><li>y</li></ul>", "<p>a</p>b", "a<br>b", "<b>a<i>b</i></b>c"]
    assert column(spark, values, markup.sanitize) == wanted


def test_strip_tags(spark):
    values = ["<p>a <strong>b</strong>  c</p>", None, "", "<p>Python &amp; JS</p>", "<p>il y&nbsp;a</p>", "Fnac & Darty"]
    assert column(spark, values, markup.strip_tags) == ["a b c", "", "", "Python & JS", "il y a", "Fnac & Darty"]


def test_native_variant_on_well_formed_pages(spark):
    values = ["<html><style>p{}</style><body><p>a</p> <b>b</b><!-- c --></body></html>"]
    assert column(spark, values, markup.strip_tags_native) == column(spark, values, markup.strip_tags) == ["a b"]


def test_excerpts(spark):
    long = "mot " * 200
    got = column(spark, ["<p>Un <b>resume</b>.</p>", None, long, "x" * 300, "y" * 240], markup.excerpt)
    assert got == ["Un resume.", "", ("mot " * 60)[:240].rsplit(" ", 1)[0] + "…", "x" * 240 + "…", "y" * 240]
