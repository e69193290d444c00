"""Text functions of legal documents as Column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
#: Months, and number suffixes of inserted articles.
MONTHS = "january february march april may june july august september october november december".split()
SUFFIXES = "bis ter quater quinquies sexies septies octies nonies decies".split()
NUMBER = rf"[0-9IVXLCDM]+(?:\s*(?:{'|'.join(SUFFIXES)}))?"


def normalize_space(c: Column) -> Column:
    """Zero-width spaces go, runs of any white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "​", ""), WS, " "))


def for_compare(c: Column) -> Column:
    return F.lower(normalize_space(c))


def _ascii_of(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


_LATIN = [chr(n) for n in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00))]
_ONE = [c for c in _LATIN if len(_ascii_of(c)) == 1]
_MORE = [c for c in _LATIN if len(_ascii_of(c)) > 1]


def slug(c: Column) -> Column:
    """Latin letters without their marks in lower case, all else as single hyphens, none at the ends."""
    for letter in _MORE:
        c = F.replace(c, F.lit(letter), F.lit(_ascii_of(letter)))
    plain = F.regexp_replace(F.translate(c, "".join(_ONE), "".join(map(_ascii_of, _ONE))), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def article_token(c: Column) -> Column:
    return F.lower(F.regexp_replace(normalize_space(c), r"[ .]", ""))


def marker_token(c: Column) -> Column:
    """A printed marker as the last part of an id: '(1)' -> '1', '1.1 (a)' -> '1_1_a'."""
    t = F.trim(F.regexp_replace(F.regexp_replace(normalize_space(c), r"^[()]+|[()]+$", ""), r"^\.+|\.+$", ""))
    t = F.regexp_replace(F.regexp_replace(F.lower(t), r"[ )]", ""), r"[.(/]", "_")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9_-]+", ""), "_+", "_"), "^_+|_+$", "")


def is_roman(c: Column) -> Column:
    return c.rlike("(?i)^[ivxlcdm]+$")


def date_from_text(c: Column, fallback_year: Column) -> Column:
    """ISO date of the first 'Month d, yyyy'; where there is no such day, January 1st of the first year 1800-2099, else of the fallback."""
    text = normalize_space(c)
    found = rf"(?i)\b({'|'.join(MONTHS)})\s+(\d{{1,2}}),\s*(\d{{4}})\b"
    parts = [F.regexp_extract(text, found, n) for n in (1, 2, 3)]
    exact = F.try_to_date(F.initcap(F.lower(F.concat_ws(" ", *parts))), "MMMM d yyyy")
    year = F.regexp_extract(text, r"\b(1[89]\d{2}|20\d{2})\b", 1)
    first = F.when(year != "", year).otherwise(F.lpad(fallback_year.cast("string"), 4, "0"))
    return F.coalesce(F.date_format(exact, "yyyy-MM-dd"), F.concat(first, F.lit("-01-01")))


def looks_like_date(c: Column) -> Column:
    low = F.lower(c)
    return low.rlike(r"^(of|adopted|signed|concluded|done)\b") | (low.contains("amended on") & (F.length(c) < 200)) | (c.rlike(r"^\(.*\)$") & low.rlike("|".join(MONTHS)))


def looks_like_contents(c: Column) -> Column:
    low = F.lower(c)
    return low.rlike("table of contents|list of (the )?articles|^table of content") | (low == "contents")


def looks_editorial(c: Column) -> Column:
    low = F.lower(c)
    return low.rlike("this table of contents is added for the convenience|editor['’]s note|new contribution system") | low.isin("* *", "*")


def work_iri(kind: Column, date: Column, name: Column) -> Column:
    return F.concat(F.lit("/akn/un/act/"), kind, F.lit("/wipo/"), date, F.lit("/"), name)


def eid_of(article: Column, para: Column | None = None) -> Column:
    art = F.concat(F.lit("art_"), article_token(article))
    return art if para is None else F.concat(art, F.lit("__para_"), marker_token(para))


def file_name(year: Column, name: Column) -> Column:
    return F.format_string("%04d_%s_clean.xml", year, name)


def local_name(c: Column) -> Column:
    return F.substring_index(c, "}", -1)


def duration_years(c: Column) -> Column:
    """First number in front of 'year(s)', or null."""
    return F.regexp_extract(c, r"(?i)(\d+)\s*years?", 1).try_cast("bigint")


def exception_article(c: Column) -> Column:
    """What stands between the first opening and the last closing parenthesis, or empty."""
    return F.trim(F.regexp_extract(c, r"\((.*)\)", 1))


def duration_kind(c: Column) -> Column:
    return F.when(c.contains("70"), "life_plus_70").when(c.contains("50"), "life_plus_50").otherwise(c)


def duration_span(passage: Column, duration: Column) -> Column:
    """The passage's words on as many years as the duration text has; that text where there are none."""
    n = F.regexp_extract(duration, r"(?i)(\d+)\s+years", 1)
    found = F.call_function("regexp_extract", passage, F.concat(F.lit("(?i)"), n, F.lit(r"\s+years[^.;,]{0,60}")), F.lit(0))
    return F.when((n != "") & (found != ""), F.trim(found)).otherwise(duration)


def exclusive_span(passage: Column) -> Column:
    return F.trim(F.regexp_extract(passage, r"(?iu)(exclusive right|diritto esclusivo|ausschließliche[s]? Recht|droit exclusif)[^.\n]{0,80}", 0))


def says_yes(c: Column) -> Column:
    return F.lower(c).startswith("yes")


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def has_article(c: Column) -> Column:
    return F.coalesce(~F.trim(c).isin("", "-"), F.lit(False))


def by_death(c: Column) -> Column:
    return F.lower(c).rlike("pma|death|post mortem")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(html: Column, span: Column) -> Column:
    """html with the first occurrence of the escaped span marked."""
    s = html_escape(span)
    at = F.instr(html, s)
    marked = F.concat(F.substr(html, F.lit(1), at - 1), F.lit('<mark class="highlight">'), s, F.lit("</mark>"), F.substr(html, at + F.length(s)))
    return F.when((F.length(s) > 0) & (at > 0), marked).otherwise(html)


def underline(passage: Column, span: Column) -> Column:
    """passage as one line in quotes, the first occurrence of span in it underlined, if it is there and not empty."""
    line, s = normalize_space(passage), F.coalesce(span, F.lit(""))
    at = F.instr(line, s)
    marked = F.concat(F.substr(line, F.lit(1), at - 1), F.lit("<u>"), s, F.lit("</u>"), F.substr(line, at + F.length(s)))
    return F.concat(F.lit('"'), F.when((s != "") & (at > 0), marked).otherwise(line), F.lit('"'))


def cut_passage(c: Column, chars: int = 800) -> Column:
    return F.substring(F.trim(c), 1, chars)


def shorten(c: Column, names: dict[str, str]) -> Column:
    """An IRI with its namespace (by prefix in names) written as a prefix; the first that fits."""
    out = F.when(F.lit(False), c)
    for prefix, base in names.items():
        out = out.when(c.startswith(base), F.concat(F.lit(prefix + ":"), F.substr(c, F.lit(len(base) + 1))))
    return out.otherwise(c)


def format_reference(article: Column, paragraph: Column) -> Column:
    """'article(paragraph)', or an em dash without an article."""
    a, p = F.coalesce(article, F.lit("")), F.coalesce(paragraph, F.lit(""))
    return F.when(a == "", "—").when(p == "", a).otherwise(F.concat(a, F.lit("("), p, F.lit(")")))


def document_link(title: Column, path: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("]("), path, F.lit(")"))


def strip_code_fence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def pdf_name(path: Column) -> Column:
    """Name of the PDF beside a treaty's file: without the year in front and '_clean' behind; null for other files."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(path.contains("wipo"), F.concat(F.regexp_replace(F.regexp_replace(stem, r"^\d{4}_", ""), r"_clean$", ""), F.lit(".pdf")))
