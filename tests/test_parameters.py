"""Parameters of runs."""

import datetime

import pytest

from fernweave import parameters as P


def test_review_run():
    run = P.ReviewRun.of({"ids": ["730", 730], "urls": ["https://s.example/app/570/x"], "languages": ["English", "english", " "], "most": 99_999, "sample": "5", "start": "2025-01-31"})
    assert (run.ids, run.languages, run.most, run.sample, run.start, run.window_days) == (("730", "570"), ("english",), 10_000, 10, datetime.date(2025, 1, 31), 14)
    for wrong in ({"ids": []}, {"ids": ["x"]}, {"ids": ["1"], "start": "2025-02-30"}, {"ids": ["1"], "start": "2025-02-02", "end": "2025-01-01"}, {"ids": ["1"], "kind": "best"}, {"ids": ["1"], "most": "many"}):
        with pytest.raises(P.InvalidInput, match="INVALID_INPUT"):
            P.ReviewRun.of(wrong)


def test_product_mapping():
    products = [{"id": "a", "platforms": {"ios": "1", "android": "x"}}, {"id": "b", "platforms": {"ios": "2", "android": None}}]
    made = P.ProductMapping.of({"products": products, "countries": ["us", "vn", "us"], "languages": ["en"]})
    assert made.requests == 3 * 2
    for wrong in ({}, {"products": [*products, {"id": "c", "platforms": {"ios": "1"}}]}, {"products": [{"id": "", "platforms": {"ios": "1"}}]}, {"products": products, "most_requests": 2}):
        with pytest.raises(P.InvalidInput):
            P.ProductMapping.of(wrong)


def test_search_jobs():
    assert P.search_jobs({"en": ["play", "zoo "], "vi": ["zoo"]}, ["A", "B", "A"], ["en", "vi"]) == [("play", "A"), ("zoo", "A"), ("play", "B"), ("zoo", "B")]
