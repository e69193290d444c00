"""Citations, headings and markers of provisions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NUMBER, WS, article_token, marker_token, normalize_space

#: Names of laws that may follow a citation, and labels that may stand in front of it.
LAWS = ["UrhG", "URG", "CopA", "LDA", "CDPA", "CPI", "C-42", r"17 U\.S\.C\.", "Copyright Act", "InfoSoc", r"Directive \S+", "Rental Directive", "Software Directive"]
LABELS = ["articles?", "artikel", r"art\.?", "sections?", r"sec\.?", r"s\.", "§"]


def without_law(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\xa0"), F.lit(" ")), rf"(?is)\s+(?:{'|'.join(LAWS)})[^\n]*$", "")


def norm_ref(c: Column) -> Column:
    """A citation without law, extra spaces, and all from its first '(digits)' on."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(without_law(c), WS, " ")), r"\([0-9]+\).*$", ""))


def sub_refs(c: Column) -> Column:
    """What stands in parentheses, in order: 'Art. 5(2)(b) InfoSoc' -> ['2', 'b']."""
    return F.regexp_extract_all(without_law(c), F.lit(r"(?U)\((\w+)\)"), F.lit(1))


def num_token(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s.]", "")


def without_label(c: Column) -> Column:
    return bare(F.regexp_replace(F.trim(c), rf"(?iu)^(?:{'|'.join(LABELS)})\s*", ""))


def prefix_match(query: Column, candidate: Column) -> Column:
    """candidate starts with query, and not as part of a longer number or word."""
    after = F.substr(candidate, F.length(query) + 1, F.lit(1))
    return candidate.startswith(query) & ~after.rlike(r"(?U)^[\p{L}\p{N}]")


def refs_match(query: Column, candidate: Column) -> Column:
    """The same provision: equal or guarded prefix as written, without spaces and dots, or without labels."""
    q2, c2, q3, c3 = bare(query), bare(candidate), without_label(query), without_label(candidate)
    some = (query != "") & (candidate != "")
    return some & ((query == candidate) | prefix_match(query, candidate) | (q2 == c2) | prefix_match(q2, c2) | ((q3 != "") & ((q3 == c3) | prefix_match(q3, c3))))


def ref_keys(c: Column) -> Column:
    """Join keys of a normalised citation: two that match share one, the start of the bare number in either form."""
    head = lambda x: F.regexp_extract(x, r"(?U)^[^\p{L}\p{N}]*[\p{L}\p{N}]*", 0)
    return F.array_distinct(F.array(F.concat(F.lit("b"), head(bare(c))), F.concat(F.lit("l"), head(without_label(c)))))


def article_heading(c: Column) -> Column:
    """struct(token, display, heading) of an article's heading line, or null."""
    pattern = rf"(?i)^Article\s+({NUMBER})\b\s*[:\-–]?\s*(.*)$"
    token = article_token(F.regexp_replace(normalize_space(F.regexp_extract(c, pattern, 1)), " ", ""))
    heading = F.regexp_replace(normalize_space(F.regexp_extract(c, pattern, 2)), "^[:\\- ]+", "")
    return F.when(c.rlike(pattern), F.struct(token.alias("token"), F.when(token.rlike("^[a-z]+$"), F.upper(token)).otherwise(token).alias("display"), heading.alias("heading")))


def container_heading(c: Column) -> Column:
    """struct(kind, num, heading, split) of a chapter, part, title or book, or of a Roman-numbered act that starts a segment."""
    named, roman = r"(?i)^(CHAPTER|PART|TITLE|BOOK)\s+([0-9IVXLCDM]+)\b\s*[:\-–]?\s*(.*)$", r"^([IVXLCDM]+)\b\s+(.*)$"
    act = F.regexp_extract(c, roman, 2).rlike(r"(?i)\b(act|protocol|agreement)\b")
    of = lambda kind, num, heading, split: F.struct(kind.alias("kind"), F.upper(normalize_space(num)).alias("num"), normalize_space(heading).alias("heading"), F.lit(split).alias("split"))
    first = of(F.lower(F.regexp_extract(c, named, 1)), F.regexp_extract(c, named, 2), F.regexp_extract(c, named, 3), False)
    return F.when(c.rlike(named), first).when(c.rlike(roman) & act, of(F.lit("part"), F.regexp_extract(c, roman, 1), F.regexp_extract(c, roman, 2), True))


#: Patterns of printed markers, the first that fits counts: pattern, text around the marker.
MARKERS = [
    (r"^\(([0-9]+)\)\s*(.*)$", "(", ")"),
    (r"^\(([A-Za-z]+)\)\s*(.*)$", "(", ")"),
    (r"^([0-9]+(?:\.[0-9]+)+(?:\s*\([A-Za-z]+\))?)\s*(.*)$", "", ""),
    (r"^([A-Za-z])\.\s*(.*)$", "", "."),
    (r"^([0-9]+)\.\s*(.*)$", "", "."),
    (r"(?i)^([ivxlcdm]+)\)\s*(.*)$", "", ")"),
]


def marker(c: Column) -> Column:
    """struct(raw, token, text): the printed marker at the start of a line, and the rest; nulls and the line where there is none."""
    none = F.lit(None).cast("string")
    out = F.when(F.lit(False), F.struct(none.alias("raw"), none.alias("token"), c.alias("text")))
    for pattern, before, after in MARKERS:
        found = F.regexp_replace(normalize_space(F.regexp_extract(c, pattern, 1)), " ", "")
        out = out.when(c.rlike(pattern), F.struct(F.concat(F.lit(before), found, F.lit(after)).alias("raw"), marker_token(found).alias("token"), normalize_space(F.regexp_extract(c, pattern, 2)).alias("text")))
    out = out.when(c.rlike(r"^-\s*(.*)$"), F.struct(F.lit("-").alias("raw"), none.alias("token"), normalize_space(F.regexp_extract(c, r"^-\s*(.*)$", 1)).alias("text")))
    return out.otherwise(F.struct(none.alias("raw"), none.alias("token"), c.alias("text")))


def marker_kind(raw: Column, token: Column) -> Column:
    r, t = F.coalesce(raw, F.lit("")), F.coalesce(token, F.lit(""))
    letters = r.rlike(r"^\([A-Za-z]+\)$") | r.rlike(r"^[A-Za-z]\.$")
    return (
        F.when(r == "", "none")
        .when(r.rlike(r"^\([0-9]+\)$"), "numeric")
        .when(r.rlike(r"^[0-9]+(?:\.[0-9]+)+(?:\([A-Za-z]+\))?$"), "dotted_numeric")
        .when(r.rlike(r"^[0-9]+\.$"), "numeric")
        .when(letters & t.rlike("(?i)^[ivxlcdm]+$"), "roman")
        .when(letters, "alpha")
        .when(r.rlike(r"(?i)^[ivxlcdm]+\)$"), "roman")
        .otherwise("other")
    )


def segment_name(base: Column, title: Column, index: Column) -> Column:
    low = F.lower(title)
    return F.when(index == 0, base).when(low.contains("additional act"), F.concat(base, F.lit("-additional-act"))).when(low.contains("protocol"), F.concat(base, F.lit("-protocol"))).otherwise(F.concat(base, F.lit("-part"), (index + 1).cast("string")))


DEFINITION = "(?i)[\"“]([^\"”]{2,140})[\"”]\\s+(?:shall\\s+mean|means|is\\s+defined\\s+as)\\b"
REFERENCE = rf"(?i)\bArticle(?:s)?\s+({NUMBER})(?:\s*\(([^)]+)\))?"


def definitions(c: Column) -> Column:
    """Terms that a text defines, in order."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(DEFINITION), F.lit(1)), lambda t: F.regexp_replace(normalize_space(t), '^[“”"]+|[“”"]+$', "")), lambda t: t != "")


def references(c: Column) -> Column:
    """array<struct<article, para>> of the articles that a text names, in order; para is empty where none is named."""
    whole = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    return F.transform(whole, lambda x: F.struct(F.regexp_extract(x, REFERENCE, 1).alias("article"), F.regexp_extract(x, REFERENCE, 2).alias("para")))
