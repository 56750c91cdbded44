"""Paged REST scans against plain loops over the same replies."""

from __future__ import annotations

import pytest

from tarnmill.sources import rest

KIND = "struct<id:int,resources:array<struct<format:string,url:string>>>"


def sets(n):
    """Every third dataset has a CSV file; the fifth is no object, the seventh has no resources."""
    for i in range(n):
        yield "junk" if i == 5 else {"id": i} if i == 7 else {"id": i, "resources": [{"format": "csv" if i % 3 == 0 else "exe", "url": ""}]}


def catalog(records, total=True):
    def fetch(endpoint, params):
        at = params["start"]
        return {"success": True, "result": {"count": len(records) if total else None, "results": records[at : at + params["rows"]]}}

    return fetch


def plain(records, start, most):
    good = [r["id"] for r in records[start:] if isinstance(r, dict) and any(x["format"] == "csv" for x in r.get("resources", []))]
    return list(enumerate(good[:most], 1))


@pytest.mark.parametrize(("start", "rows", "most", "total"), [(0, 10, 7, True), (4, 3, 1000, True), (0, 7, 1000, False), (0, 100, 5, True), (99, 10, 3, True)])
def test_catalog_caps_after_the_filter(spark, start, rows, most, total):
    records = list(sets(60))
    found = rest.read_catalog(spark, catalog(records, total), "search", {"rows": rows, "start": start}, KIND, ["csv"], most, pages_a_task=2)
    assert sorted((r.number, r.record.id) for r in found.collect()) == plain(records, start, most)


def test_a_small_cap_reads_few_pages(spark, tmp_path):
    records = list(sets(600))

    def fetch(endpoint, params):
        (tmp_path / str(params["start"])).touch()
        return catalog(records)(endpoint, params)

    assert rest.read_catalog(spark, fetch, "search", {"rows": 10, "start": 0}, KIND, ["csv"], 20).count() == 20
    assert len(list(tmp_path.iterdir())) <= 14


def test_catalog_failures(spark):
    with pytest.raises(ValueError, match="no success"):
        rest.read_catalog(spark, lambda *_: {"success": False}, "search", {"rows": 5, "start": 0}, KIND, ["csv"], 5)
    for bad in ({"rows": 0, "start": 0}, {"rows": 5, "start": -1}, {"rows": "x", "start": 0}):
        with pytest.raises(ValueError, match="rows"):
            rest.read_catalog(spark, catalog([]), "search", bad, KIND, ["csv"], 5)


def speeches(lengths, stuck=False):
    def fetch(endpoint, params):
        at, n = params["startRecord"], lengths[params["q"]]
        assert params["recordPacking"] == "json"
        following = at + params["maximumRecords"]
        return {"speechRecord": [{"id": i} for i in range(at, min(following, n + 1))], "nextRecordPosition": at if stuck else str(following) if following <= n else None}

    return fetch


def test_cursors_are_followed_to_the_cap(spark):
    lengths = {"a": 25, "b": 0, "c": 7, "d": 1000}
    queries = [{"q": q} for q in lengths]
    found = rest.read_speeches(spark, speeches(lengths), "/api/speech", "speech", queries, "struct<id:int>", most=35, size=10)
    got = sorted((r.scan, r.record.id) for r in found.collect())
    assert got == [(k, i) for k, n in enumerate(lengths.values()) for i in range(1, min(n, 35) + 1)]


def test_one_page_without_a_cap(spark):
    for kind, size, n in (("speech", 10, 10), ("speech", 1, 1), ("speech", 500, 100), ("meeting", 50, 10), ("list", None, 10)):
        found = rest.read_speeches(spark, speeches({"a": 1000}), "/api", kind, [{"q": "a"}], "struct<id:int>", size=size) if kind == "speech" else None
        assert rest.page_size(kind, size) == n
        if found is not None:
            assert found.count() == n


def test_a_cursor_that_stands_still_ends_the_scan(spark):
    assert rest.read_speeches(spark, speeches({"a": 30}, stuck=True), "/api", "speech", [{"q": "a"}], "struct<id:int>", most=1000, size=10).count() == 10
