import json

import pytest

from skein.sources import library as L

BIB = '@article{k1,\n  title = {The {Big} Map},\n  doi = "10.48550/arXiv.2401.00001",\n  year = 2024\n}\n@misc{k2, title = {No date}, eprint = {2402.12345}}\n@misc{k3, year = {1999}}\n'


def test_reading_lists():
    assert L.reading_list(BIB, "a.bib") == [("k1", "The {Big} Map", "Imported", "2401.00001", "10.48550/arxiv.2401.00001", 2024), ("k2", "No date", "Imported", "2402.12345", "", None)]
    csl = [{"id": "x", "title": " T ", "DOI": "10.1/X", "URL": "https://arxiv.org/abs/2301.00002v3", "issued": {"date-parts": [[2023, 1]]}, "custom": {"list": "mine"}}, {"id": "none"}]
    want = [("x", "T", "mine", "2301.00002", "10.1/x", 2023)]
    assert L.reading_list(json.dumps(csl), "b.json") == L.reading_list(json.dumps({"items": csl}), "b.json") == want
    for bad in ("", "[", "[]", '[{"id": 1}]'):
        with pytest.raises(ValueError):
            L.reading_list(bad, "c")


def test_views():
    view = {"org": ["cmu"], "author": [3, 0], "topic": [7], "cites": (5, 90), "months": (14, 20), "paper": 11}
    text = L.encode_view(view, 1991, 400)
    assert L.decode_view(text, 1991, 12) == view
    assert L.encode_view({}, 1991, 400) == "" and L.decode_view("", 1991, 12) == {}
    assert L.decode_view("author=,x,-1&paper=12&from=1990-01&to=1991-13&cmin=abc", 1991, 12) == {}


def test_rosters(spark):
    member = {"openalex_id": "A1", "provenance": "registry", "valid_from": "2024-01-01", "valid_to": "2024-12-31"}
    doc = {"version": 1, "organizations": [{"key": "lab", "organization_id": "local:lab", "members": [member, {"openalex_id": "A2", "provenance": "coauthorship"}]}]}
    assert L.read_rosters(spark, doc).count() == 2
    for change in ({"openalex_id": "W1"}, {"provenance": "rumour"}, {"valid_from": "2025-01-01"}):
        with pytest.raises(ValueError):
            L.roster_claims({"version": 1, "organizations": [{"key": "lab", "organization_id": "local:lab", "members": [member | change]}]})
    with pytest.raises(ValueError):
        L.roster_claims(doc | {"organizations": doc["organizations"] * 2})
