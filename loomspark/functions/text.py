"""Column expressions over texts, URLs and versions. All are built-in expressions and stay inside the JVM; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.fences import without_comments

#: Words left out of keyword search.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "what", "when", "where", "which", "who", "why", "with")


def tokens(text: Column) -> Column:
    """Runs of letters or digits, lower-cased, without stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def word_count(text: Column) -> Column:
    """Words separated by white space; 0 for blank texts. The additive stand-in for a tokenizer's count."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def normalised(text: Column) -> Column:
    """Runs of blanks, tabs and line ends as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def contains_quote(text: Column, quote: Column) -> Column:
    """Whether the quote stands in the text up to white space; an empty quote stands nowhere."""
    q = normalised(quote)
    return (F.length(q) > 0) & F.contains(normalised(text), q)


def page_identity(url: Column, keyed: tuple[str, ...] = ("/docs/reference/toggle-register/",)) -> Column:
    """Path and query of a URL without scheme, host and, but for `keyed` pages, fragment."""
    local = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    page = F.regexp_replace(local, "#.*$", "")
    return F.when(F.regexp_replace(page, r"\?.*$", "").isin(*keyed), local).otherwise(page)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, "#(.*)$", 1)


def version_key(version: Column) -> Column:
    """A version as an array of numbers, so that 1.41 comes after 1.9."""
    return F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))


def version_mentions(text: Column) -> Column:
    """Versions with two-digit minors named in a text, in order, patch numbers dropped; parts of longer numbers don't count."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\w.])v?(1\.\d{2})(?:\.\d+)?(?!\w|\.\d)"), F.lit(1))


def anchor(heading: Column) -> Column:
    """The anchor of a heading: links give their text, runs of other than letters and digits become a dash."""
    text = F.regexp_replace(heading, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def breadcrumb(path: Column, text: Column) -> Column:
    """The heading path before the text, as an index with context embeds it."""
    return F.concat(F.array_join(path, " > "), F.lit("\n\n"), text)


def url_path(path: Column, slug: Column | None = None) -> Column:
    """content/docs/x/_index.md -> /docs/x/; a slug takes the place of the file's name."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^(?:.*/)?content/(?:[a-z]{2}/(?=docs/))?", ""), r"\.(?:md|html)$", "")
    folder, name = F.regexp_extract(inner, r"^(.*/)?[^/]*$", 1), F.regexp_extract(inner, r"([^/]*)$", 1)
    last = F.when(name.isin("_index", "index"), F.lit("")).otherwise(F.concat(F.coalesce(slug, name) if slug is not None else name, F.lit("/")))
    return F.concat(F.lit("/"), folder, last)


def front_matter(text: Column) -> Column:
    """The lines between leading --- lines, or ''."""
    return F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)


def page_title(front_title: Column, link_title: Column, text: Column, path: Column) -> Column:
    """Title, else link title, else the first heading, else the file's stem."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$", 1))
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(front_title), some(link_title), some(heading), some(stem))


def tidy(text: Column) -> Column:
    """No blanks at line ends, no three line ends in a row, one line end last; HTML comments of the prose dropped, those in fenced code kept."""
    t = without_comments(text)
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit("\n"))


def tag_count(text: Column) -> Column:
    """Tags of known names left in a text."""
    return F.regexp_count(text, F.lit(r"(?i)</?(?:a|b|br|code|div|em|h[1-6]|i|img|label|li|ol|p|pre|span|strong|sub|sup|table|tbody|td|th|thead|tr|ul)\b[^>]*>"))


def state_label(states: Column) -> Column:
    """Feature states as 'Gate: state since version', joined by '; '."""
    one = lambda s: F.concat(F.coalesce(F.concat(s["feature_gate"], F.lit(": ")), F.lit("")), s["state"], F.coalesce(F.concat(F.lit(" since "), s["since"]), F.lit("")))
    return F.array_join(F.transform(states, one), "; ")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for null or zero vectors and for unequal lengths."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; null for nulls and unequal lengths."""
    squares = F.zip_with(a, b, lambda u, v: (u.cast("double") - v.cast("double")) * (u.cast("double") - v.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, z: s + z)))
