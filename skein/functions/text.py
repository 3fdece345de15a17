"""Text and identifier expressions of scholarly records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The arXiv identifier, in its forms since 2007 and before.
ARXIV_NEW, ARXIV_OLD = r"(\d{4}\.\d{4,5})", r"([a-z-]+(?:\.[A-Z]{2})?/\d{7})"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def rebuild_text(index: Column) -> Column:
    """Text of an inverted index (map of word to positions): each word at its places, gaps closed, null if there is none.

    Of several words at one place the one listed last stays.
    """
    places = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), (-i).alias("order"), e["key"].alias("w")))))
    # One-element transform: the places are sorted once, not once per place.
    kept = F.transform(F.array(F.array_sort(places)), lambda o: F.filter(o, lambda x, i: (i == 0) | (x["p"] != F.get(o, i - 1)["p"])))[0]
    return blank_to_null(F.array_join(F.transform(kept, lambda x: x["w"]), " "))


def invert_words(words: Column) -> Column:
    """Map of word to its positions in an array of words; for short arrays, as each different word goes through all of them."""
    at = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.transform(F.filter(at, lambda x: x["w"] == w), lambda x: x["i"]))))


def inverted(words: Column) -> Column:
    """Map of word to its positions in an array of words, of any length: words are sorted, and each run of one word is a slice."""
    # One-element transforms: the words are sorted, and the runs found, once, not once per word.
    sorted_ = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    first = lambda o: F.filter(F.sequence(F.lit(0), F.size(o)), lambda i: (i == 0) | (i == F.size(o)) | (F.get(o, i)["w"] != F.get(o, i - 1)["w"]))
    runs = F.transform(F.array(sorted_), lambda o: F.struct(o.alias("o"), first(o).alias("at")))
    entry = lambda r, at, i: F.struct(F.get(r["o"], at)["w"].alias("w"), F.transform(F.slice(r["o"], at + 1, F.get(r["at"], i + 1) - at), lambda x: x["i"]).alias("at"))
    entries = F.transform(runs, lambda r: F.transform(F.slice(r["at"], 1, F.size(r["at"]) - 1), lambda at, i: entry(r, at, i)))[0]
    return F.map_from_entries(F.when(F.size(words) > 0, entries).otherwise(F.slice(entries, 1, 0)))


def embed_text(title: Column, abstract: Column) -> Column:
    """`title. abstract`, or the one that is there."""
    return F.concat_ws(". ", blank_to_null(F.trim(title)), blank_to_null(F.trim(abstract)))


def short_id(url: Column) -> Column:
    """Last path segment."""
    return blank_to_null(F.regexp_extract(url, r"([^/]+)/*$", 1))


def numeric_id(url: Column) -> Column:
    """Digits of the last path segment, else -1."""
    return F.coalesce(F.regexp_replace(short_id(url), r"\D", "").try_cast("int"), F.lit(-1))


def clean_doi(doi: Column) -> Column:
    """A DOI without the resolver's address, whole path kept; empty is null."""
    return blank_to_null(F.regexp_replace(F.trim(doi), r"(?i)^(https?://)?(dx\.)?doi\.org/", ""))


def arxiv_of_doi(doi: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.lower(doi), r"arxiv\.(.+)$", 1))


def arxiv_month(arxiv_id: Column) -> Column:
    """First day of the month in an arXiv id's YYMM (91 and later are 19yy); null for months outside 1 to 12."""
    digits = F.regexp_extract(arxiv_id, r"(?:^|/)(\d{4})", 1)
    yy, mm = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    return F.when(mm.between(1, 12), F.make_date(F.when(yy >= 91, 1900 + yy).otherwise(2000 + yy), mm, F.lit(1)))


def prefer_month(date: Column, month: Column) -> Column:
    """The day of date if it lies in month, else the month's first; without a month, date."""
    return F.when(month.isNull(), date).when(F.trunc(date, "month") == month, date).otherwise(month)


def arxiv_in(text: Column) -> Column:
    """The first arXiv id in a text, without version."""
    forms = (rf"(?i)arxiv\.org/(?:abs|pdf)/{ARXIV_NEW}", rf"(?i)arxiv\.org/(?:abs|pdf)/{ARXIV_OLD}", rf"(?i)10\.48550/arxiv\.{ARXIV_NEW}", rf"(?i)arxiv:\s*{ARXIV_NEW}", rf"^{ARXIV_NEW}(?:v\d+)?$")
    return F.coalesce(*[blank_to_null(F.regexp_extract(text, f, 1)) for f in forms])


def without_version(arxiv_id: Column) -> Column:
    return F.regexp_replace(arxiv_id, r"v\d+$", "")


def name_id(name: Column) -> Column:
    """Identifier of an author known by name alone."""
    return F.concat(F.lit("arxiv-name:"), F.substring(F.sha1(F.regexp_replace(F.lower(name), r"(?U)\W+", "")), 1, 16))


def hash_id(c: Column) -> Column:
    """Non-negative 31-bit number of a string."""
    return F.crc32(c.cast("binary")).bitwiseAND(F.lit(2147483647))


def person_name(last: Column, first: Column, suffix: Column, raw: Column) -> Column:
    return F.coalesce(blank_to_null(squeeze(F.concat_ws(" ", first, last, suffix))), raw)


def normal_title(title: Column) -> Column:
    """Lower case, TeX signs dropped, everything but letters and digits one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[{}$\\]", ""), r"[^a-z0-9]+", " "))


# What is no text in a title or abstract, in the order in which it has to go: attributes before tags, as a cut-off tag leaves them behind.
MARKUP = (r"https?://\S+|www\.\S+", r"\b[a-zA-Z-]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", r"<[^>]*>", r"\b[a-zA-Z]+:[a-zA-Z]+\b", r"&[a-z]+;|&#\d+;")


def clean_markup(c: Column) -> Column:
    """Text without addresses, attributes (quoted or bare), tags, namespaces and entities."""
    for pattern in MARKUP:
        c = F.regexp_replace(c, pattern, " ")
    return squeeze(c)


def search_tokens(title: Column) -> Column:
    """Distinct lower-case tokens of two letters or digits and more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2))


def first_stamp_date(stamp: Column) -> Column:
    """Date of an RFC 2822 time stamp, in its own zone; null if it is none."""
    return F.try_to_date(blank_to_null(F.regexp_extract(stamp, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1)), "d MMM yyyy")


def fresh(stamp: Column, as_of: Column, days: int) -> Column:
    """Whether a time stamp is at most so many days old; 0 days: always, no stamp: never."""
    if days == 0:
        return F.lit(True)
    return F.coalesce(F.try_to_timestamp(stamp) >= as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def month_index(date: Column, origin_year: Column | int) -> Column:
    """Months since January of the origin year, at least 0; a bad month counts as January."""
    y, m = F.substring(date, 1, 4).try_cast("int"), F.substring(date, 6, 2).try_cast("int")
    m = F.when(m.between(1, 12), m).otherwise(1)
    return F.greatest(F.lit(0), 12 * (y - origin_year) + m - 1)


_BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def first_caption(line: Column) -> Column:
    """Whether a line captions a paper's first figure or table, or number 1 of a chapter.

    The line is read as a label word, a number, and what follows. The number is 1, alone or with a number after a full stop. After a figure's comes a blank, the line's end, or a colon or full stop and a blank; after a
    table's, blanks aside, the line's end, or a colon or full stop and a blank, so that a sentence that begins with a table is none.
    """
    whole = F.trim(line)
    word = F.regexp_extract(whole, r"^[A-Za-z]+\.?", 0)
    rest = F.regexp_replace(F.substring(whole, F.length(word) + 1, F.length(whole)), r"^\s+", "")
    number = F.regexp_extract(rest, r"^\d+(\.\d+)?", 0)
    after = F.substring(rest, F.length(number) + 1, F.length(rest))
    bare = F.regexp_replace(after, r"^\s+", "")
    marked = lambda c: F.substring(c, 1, 1).isin(":", ".") & F.substring(c, 2, 1).isin(*_BLANKS)
    one = F.element_at(F.split(number, r"\."), 1) == "1"
    figure = F.lower(word).isin("figure", "fig", "fig.") & ((after == "") | F.substring(after, 1, 1).isin(*_BLANKS) | marked(after))
    table = (F.lower(word) == "table") & ((bare == "") | marked(bare))
    return one & (figure | table)
