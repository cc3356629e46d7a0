"""The index of WARC bundles by record id, and cells of shards by the number of rows."""

from quern.llm import shards, warc


def test_index_maps_record_ids(spark):
    body = "a page of more than a hundred bytes " * 5
    pages = spark.createDataFrame([(1, "u1", body), (2, "u2", body), (3, "u3", "short"), (None, "u4", None)], "page_id long, url string, html string")
    index = warc.write_bundles(pages)
    read = {r["page_id"]: r for r in warc.read_records(index).collect()}
    rows = {r["page_id"]: r for r in index.collect()}
    assert all(r["record_id"] == warc.record_id(k, read[k]["digest"]) for k, r in rows.items()) and len({r["record_id"] for r in rows.values()}) == 4
    # one record by its id alone
    wanted = index.where(index.record_id == rows[2]["record_id"])
    (found,) = warc.read_records(wanted).collect()
    assert (found["page_id"], found["record_type"], found["refers_to"]) == (2, "revisit", 1)


def test_cells_grow_with_the_rows():
    assert [shards.cells_for(n, 8) for n in (0, 10**6, 10**10, 10**11, 10**15)] == [512, 512, 1250, 12_500, 65_536]
