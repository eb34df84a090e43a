"""Pages made of texts hold every character."""

import __spark_entry__ as entry


def test_texts_are_whole(spark, tmp_path):
    texts = ["a" * 63, "b" * 64, "c" * 130, "é😀", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.page_id, r.y): (r.s, r.brightest) for r in entry.queries()["o164_whole_text_rows"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), 64):
            levels = [min(255, ord(c)) for c in t[at : at + 64]]
            want[i, at // 64] = (sum(levels), max(levels))
    assert got == want
    full = {(r.page_id, r.y) for r in entry.queries()["o164_text_rows"](spark, str(tmp_path)).collect()}
    assert full == {(1, 0), (2, 0), (2, 1)}


def test_tiles_of_packed_pages(spark):
    """Packed pages are equalised as exploded ones, whatever the tiles, and the query shuffles nothing."""
    import numpy as np

    from folio import catalog
    from folio.kernels import vision
    from folio.operators import areas

    rng = np.random.default_rng(4)
    for h, w, grid, clip in ((8, 8, 2, 32.0), (11, 7, 3, 4.0), (30, 20, 4, 2.0)):
        pages = [rng.integers(0, 256, (h, w)), rng.integers(90, 100, (h, w)), np.where(rng.random((h, w)) < 0.5, 0, 255), np.full((h, w), 7)]
        px = spark.createDataFrame([(p, y, x, int(v[y, x])) for p, v in enumerate(pages) for y in range(h) for x in range(w)], "page_id long, y int, x int, v int")
        for r in areas.local_equalised(px, w, h, grid, clip).collect():
            pages[r.page_id][r.y, r.x] = pages[r.page_id][r.y, r.x] * 1000 + r.v
        for v in pages:
            assert (vision.tiles_equalised((v // 1000).astype(np.uint8), grid, clip) == v % 1000).all()
    assert "Exchange" not in catalog.queries()["o028_clahe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_a_page_that_fails_is_no_result(spark):
    """Pixels of a page that could not be changed came out as if they had been."""
    import numpy as np
    import pytest

    from folio.kernels import masks, vision
    from folio.rasters import PAGE

    page = bytearray(np.arange(64, dtype=np.uint8).tobytes())
    pages = spark.createDataFrame([(1, 8, 8, 1, page), (2, 8, 8, 1, page[:63])], PAGE)
    equalised = lambda df: masks.each_page(df, lambda v, row: vision.tiles_equalised(v, 2, 32.0)).collect()
    assert [r.page_id for r in equalised(pages.where("page_id = 1"))] == [1]
    with pytest.raises(Exception, match="page 2, 8 x 8, 63 bytes"):
        equalised(pages)


def test_embeddings_of_any_length_are_whole_pages(spark, tmp_path):
    """o028_clahe of short, long and broken embeddings, as its SQL has them; short ones came out as they were."""
    import duckdb
    import numpy as np

    rng = np.random.default_rng(5)
    whole = (rng.random((6, 70)) - 0.5).tolist()
    made = [whole[0][:64], whole[1][:63], whole[2], whole[3][:1], [], None, [None, *whole[4][:63]]]
    at = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(at)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{at}/*.parquet'")
    for name in ("o028_clahe", "o164_packed_and_back"):
        got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select("page_id", "y", "x", "v").collect()))
        assert got == sorted(con.sql(f"select page_id, y, x, v from ({entry.oracle_sql()[name]})").fetchall())
        assert len(got) == 64 * len(made)
