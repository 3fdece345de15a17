"""Small documents read on the driver: reading lists, saved views, rosters."""

from __future__ import annotations

import json
import re
from datetime import date
from urllib.parse import parse_qs, urlencode

from pyspark.sql import DataFrame, SparkSession

READING_ITEM = "key string, title string, list string, arxiv_id string, doi string, year int"
_ARXIV = re.compile(r"\d{4}\.\d{4,5}")


def _arxiv(*texts: str) -> str | None:
    for t in texts:
        m = re.search(r"(?:arxiv\.org/(?:abs|pdf)/|10\.48550/arxiv\.|arxiv:\s*)(\d{4}\.\d{4,5})", t or "", re.IGNORECASE)
        if m:
            return m[1]
    return None


def _braced(text: str, at: int) -> tuple[str, int]:
    """The value that begins at a brace or quote, and where it ends."""
    close, depth, begin = {"{": "}", '"': '"'}[text[at]], 1, at + 1
    at = begin
    while at < len(text) and depth:
        c = text[at]
        if c == close and (close == "}" or text[at - 1] != "\\"):
            depth -= 1
        elif c == "{" and close == "}":
            depth += 1
        at += 1
    return text[begin : at - 1], at


def bibtex_items(text: str) -> list[dict]:
    """Entries of a BibTeX file as dicts of lower-case field names; values in braces (nested) or quotes, or bare."""
    out = []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]*)\s*,", text):
        fields, at = {"_key": m[2]}, m.end()
        while f := re.compile(r"\s*,?\s*(\w+)\s*=\s*").match(text, at):
            at = f.end()
            if at < len(text) and text[at] in '{"':
                value, at = _braced(text, at)
            else:
                bare = re.compile(r"[^,}\s]*").match(text, at)
                value, at = bare[0], bare.end()
            fields[f[1].lower()] = " ".join(value.split())
        out.append(fields)
    return out


def reading_list(text: str, name: str) -> list[tuple]:
    """Rows of READING_ITEM from BibTeX, a CSL-JSON array or an {items: [...]} file. Entries without a title are dropped; ValueError if none is left."""
    rows = []
    if not text.lstrip().startswith(("{", "[")):
        for f in bibtex_items(text):
            title, doi, eprint = f.get("title", ""), f.get("doi", "").lower(), f.get("eprint", "")
            if title:
                year = re.match(r"\d+", f.get("year", ""))
                rows.append((f["_key"] or title, title, "Imported", eprint if _ARXIV.fullmatch(eprint) else _arxiv(eprint, doi, f.get("url", "")), doi, int(year[0]) if year else None))
    else:
        try:
            parsed = json.loads(text)
        except ValueError as e:
            raise ValueError(f"{name}: not valid JSON") from e
        for raw in parsed if isinstance(parsed, list) else parsed.get("items") or []:
            title, doi, custom = str(raw.get("title") or "").strip(), str(raw.get("DOI") or "").strip().lower(), raw.get("custom") or {}
            parts = ((raw.get("issued") or {}).get("date-parts") or [[None]])[0]
            year = parts[0] if parts and isinstance(parts[0], int) else None
            if title:
                rows.append((str(raw.get("id") or title), title, str(custom.get("list") or name.rpartition(".")[0] or name), custom.get("arxiv_id") or _arxiv(doi, str(raw.get("URL") or ""), str(raw.get("note") or "")), doi, year))
    if not rows:
        raise ValueError(f"{name}: no entries with a title")
    return rows


def read_reading_list(spark: SparkSession, text: str, name: str) -> DataFrame:
    return spark.createDataFrame(reading_list(text, name), READING_ITEM)


_LISTS = {"author": "author", "field": "subfield", "topic": "topic", "region": "region"}


def encode_view(view: dict, origin_year: int, months: int) -> str:
    """A view (org, author, subfield, topic, region: lists; cites, months: bounds; paper) as a query string; what is not set is left out."""
    q: dict[str, str] = {}
    if view.get("org"):
        q["org"] = ",".join(view["org"])
    for short, name in _LISTS.items():
        if view.get(name):
            q[short] = ",".join(map(str, view[name]))
    low, high = view.get("cites", (0, None))
    first, last = view.get("months", (0, months))
    show = lambda m: f"{origin_year + m // 12}-{m % 12 + 1:02d}"
    q |= {k: v for k, v, ok in (("cmin", low, low), ("cmax", high, high is not None), ("from", show(first), first > 0), ("to", show(last), last < months), ("paper", view.get("paper"), view.get("paper") is not None)) if ok}
    return urlencode(q, safe=",")


def decode_view(text: str, origin_year: int, papers: int) -> dict:
    """The view in a query string. Malformed values are dropped, not read as zero, and so is a paper that the corpus does not have."""
    q = {k: v[0] for k, v in parse_qs(text.lstrip("?")).items()}
    whole = lambda s: int(s) if re.fullmatch(r"\d+", s.strip()) else None
    view: dict = {}
    if orgs := [x for x in q.get("org", "").split(",") if x]:
        view["org"] = orgs
    for short, name in _LISTS.items():
        if ids := [n for x in q.get(short, "").split(",") if (n := whole(x)) is not None]:
            view[name] = ids
    low, high = whole(q.get("cmin", "")), whole(q.get("cmax", ""))
    if low or high is not None:
        view["cites"] = (low or 0, high)
    month = lambda s: 12 * (int(m[1]) - origin_year) + int(m[2]) - 1 if (m := re.fullmatch(r"(\d{4})-(0[1-9]|1[0-2])", s)) else None
    bounds = [b if b is not None and b >= 0 else None for b in (month(q.get("from", "")), month(q.get("to", "")))]
    if any(b is not None for b in bounds):
        view["months"] = tuple(bounds)
    paper = whole(q.get("paper", ""))
    if paper is not None and paper < papers:
        view["paper"] = paper
    return view


#: Where a roster claim may come from.
PROVENANCE = ("self_asserted", "registry", "publication_history", "coauthorship")


def roster_claims(doc: dict) -> list[tuple]:
    """Rows (org, author, provenance, valid_from, valid_to) of a roster document; ValueError if it breaks a rule."""
    orgs, rows = doc.get("organizations", []), []
    if doc.get("version") != 1 or len({o["key"] for o in orgs}) != len(orgs):
        raise ValueError("version must be 1 and organisation keys unique")
    for o in orgs:
        if not o["organization_id"].startswith(("local:", "https://ror.org/")):
            raise ValueError(f"{o['key']}: organization_id must be local: or a ror.org address")
        seen = set()
        for m in o.get("members", []):
            author, bounds = m["openalex_id"].strip(), [date.fromisoformat(str(m[k])) if m.get(k) else None for k in ("valid_from", "valid_to")]
            if not re.fullmatch(r"A\d+", author) or author in seen or m["provenance"] not in PROVENANCE or all(bounds) and bounds[0] > bounds[1]:
                raise ValueError(f"{o['key']}: bad, repeated or backward claim of {author}")
            seen.add(author)
            rows.append((o["key"], author, m["provenance"], *[b.isoformat() if b else None for b in bounds]))
    return rows


def read_rosters(spark: SparkSession, doc: dict) -> DataFrame:
    return spark.createDataFrame(roster_claims(doc), "org string, author string, provenance string, valid_from string, valid_to string")
