import pytest
from pyspark.sql import functions as F

from pagewright.functions import pages as P
from pagewright.operators import evaluate, histogram, layout, manifest, models
from pagewright.plans import layout_queries


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id string, text string")


def test_page_ids(spark):
    rows = spark.createDataFrame([("a/b/doc.pdf", 7), ("doc", 12345), ("x\\y\\scan.tar.gz", 1)], "p string, n int")
    assert [r[0] for r in rows.select(P.page_id(P.stem(F.col("p")), F.col("n"))).collect()] == ["doc_p0007", "doc_p12345", "scan.tar_p0001"]


def test_selection(spark):
    docs = spark.createDataFrame([("d", 2), ("e", 0)], "d string, n_pages int")
    of = lambda *a: sorted(tuple(r) for r in manifest.selected_pages(docs, *a).select("d", "page").collect())
    assert of([2, 2], [(1, 3)]) == [("d", 1), ("d", 2)] == of(None, None)
    for bad in (([0], None), (None, [(3, 1)]), (None, [(1,)])):
        with pytest.raises(ValueError):
            of(*bad)


def test_evaluation(spark):
    truth, raw = pages(spark, [("p1", "abc"), ("p9", "x")]), pages(spark, [("p1", "abd"), ("p2", "y"), ("p3", "z")])
    found, report = evaluate.evaluate(truth, raw, pages(spark, [("p7", "abc")]))
    row = report.first()
    assert (row.evaluated, row.total_processed, row.cer_corrected_mean) == (1, 3, None) and row.cer_raw_mean == pytest.approx(1 / 3)
    assert [r.page_id for r in found.collect()] == ["p1"]
    assert evaluate.evaluate(truth.limit(0), raw)[1].first().asDict() == {"skipped": True, "reason": "no ground truth", "evaluated": 0, "total_processed": 3}
    assert evaluate.evaluate(truth, raw, enabled=False)[1].first().reason == "evaluation is disabled"
    assert "1 of 3" in evaluate.markdown(row.asDict(), [r.asDict() for r in found.collect()])


def test_manifest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), (None, 4, "n")], "page_id string, at int, v string")
    got = {r.page_id: (r.v, r.position) for r in manifest.latest(rows, ["page_id"], "at").collect()}
    assert got == {"a": ("z", 1), "b": ("y", 2), None: ("n", 4)}
    old = spark.createDataFrame([("a", "ocr", "t", "1"), ("b", "ocr", "t", "2")], "page_id string, stage string, kind string, path string")
    new = spark.createDataFrame([("a", "ocr", "t", "9"), ("c", "llm", "d", "3")], old.schema)
    both = manifest.register(old, new)
    assert sorted(map(tuple, both.collect())) == [("a", "ocr", "t", "9"), ("b", "ocr", "t", "2"), ("c", "llm", "d", "3")]
    assert sorted(map(tuple, manifest.as_rows(manifest.as_maps(both)).collect())) == sorted(map(tuple, both.collect()))
    assert manifest.unknown_pages(new, old).count() == 1
    assert [r.page_id for r in manifest.pending(both, old).collect()] == ["c"] and manifest.pending(both, old, force=True).count() == 3
    with pytest.raises(RuntimeError):
        manifest.require(both, old, "ocr")
    fall = manifest.with_fallback(both.select("page_id"), old.filter("page_id = 'a'"), new)
    assert {r.page_id: r.path for r in fall.collect()} == {"a": "1", "b": None, "c": "3"}


def test_reading_order(spark):
    boxes = spark.createDataFrame([("p", 50, 10), ("p", 5, 10), ("p", 0, 3)], "page_id string, x int, y int").withColumns({"w": F.lit(10), "h": F.lit(5)})
    assert [(r.x, r.y) for r in layout.reading_order(boxes).orderBy("order").collect()] == [(0, 3), (5, 10), (50, 10)]
    two = spark.createDataFrame([("p", 40, 0, 20), ("p", 10, 50, 20)], "page_id string, x int, y int, w int").withColumn("h", F.lit(1))
    assert [r.x for r in layout.reading_order(two, two_columns=True, width=F.lit(100)).orderBy("order").collect()] == [10, 40]


def test_region_filter(spark):
    rows = spark.createDataFrame([(100, 50), (29, 500), (100, 49)], "w int, h int")
    assert [tuple(r) for r in layout.region_filter(rows).collect()] == [(100, 50)]


def smooth_slowly(profile, reach=4):
    def at(i):
        n = len(profile)
        while n > 1 and not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return profile[0 if n == 1 else i]

    return [sum(at(i + k) for k in range(-reach, reach + 1)) / (2 * reach + 1) for i in range(len(profile))]


def test_segment_lines(spark):
    import numpy as np

    for profile in ([0] * 15 + [40] * 20 + [0] * 12 + [35] * 14 + [0] * 9, [7], [3, 9], [0] * 30, [50] * 40):
        rows = spark.createDataFrame([("r", y + 5, v) for y, v in enumerate(profile)], "region string, y int, ink int")
        slow = smooth_slowly(profile)
        got = [r.smooth for r in layout.smooth(rows, "region").orderBy("y").collect()]
        assert got == pytest.approx(slow)
        bound = max(5.0, float(np.percentile(slow, 60)))
        assert layout.thresholds(rows, "region").first().threshold == pytest.approx(bound)
        runs, start = [], None
        for i, on in enumerate([v >= bound for v in slow] + [False]):
            if on and start is None:
                start = i
            if not on and start is not None:
                if i - start >= 10:
                    runs.append([start, i - 1])
                start = None
        merged = []
        for r in runs:
            if merged and r[0] - merged[-1][1] - 1 <= 3:
                merged[-1][1] = r[1]
            else:
                merged.append(r)
        assert [(r.y - 5, r.h) for r in layout.segment_lines(rows, "region").orderBy("y").collect()] == [(a, b - a + 1) for a, b in merged]


def test_runs_and_gaps(spark):
    on = [*range(0, 9), *range(20, 30), *range(33, 43), *range(47, 57)]
    rows = spark.createDataFrame([("r", y, y in on) for y in range(60)], "region string, y int, on boolean")
    runs = layout.runs(rows, "region")
    assert sorted((r.top, r.bottom) for r in runs.collect()) == [(20, 29), (33, 42), (47, 56)]
    assert sorted((r.top, r.bottom) for r in layout.merged(runs, "region").collect()) == [(20, 42), (47, 56)]


def test_tight_crops_of_whole_crops(spark):
    """The same as of a table of pixels, without a shuffle."""
    images = {"l": [[0 if 10 <= x <= 30 + y else 255 for x in range(40)] for y in range(2)], "few": [[0] * 4 + [255] * 36], "none": [[255] * 40], "all": [[0] * 40]}
    crops = spark.createDataFrame(list(images.items()), "line string, rows array<array<int>>")
    pixels = crops.select("line", F.posexplode("rows").alias("y", "row")).select("line", "y", F.posexplode("row").alias("x", "v"))
    found = layout.tight_crops_whole(crops, "line", rows=F.col("rows"), width=F.lit(40), height=F.lit(25))
    assert sorted(found.collect()) == sorted(layout.tight_crops(pixels, "line", width=F.lit(40), height=F.lit(25)).collect()) == [("all", 0, 40), ("l", 6, 36)]
    assert layout.tight_crops_whole(crops, "line", rows=F.col("rows"), width=F.lit(40), height=F.lit(19)).count() == 0


def test_tight_crop_shuffles_no_pixels(spark):
    docs = layout_queries.tight_crop(spark, "/root/testdata/sf0.001")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") <= 1  # that which deals documents out


def test_tight_crop(spark):
    ink = spark.createDataFrame([("l", y, x, 0 if 10 <= x <= 30 else 255) for y in range(2) for x in range(40)], "line string, y int, x int, v int")
    row = layout.tight_crops(ink, "line", width=F.lit(40), height=F.lit(25)).first()
    assert (row.left, row.right) == (6, 35)
    assert layout.tight_crops(ink, "line", width=F.lit(40), height=F.lit(19)).count() == 0
    assert layout.tight_crops(ink.filter("x > 26"), "line", width=F.lit(40), height=F.lit(25)).count() == 0
    assert layout.bounding_boxes(ink.filter("v < 255"), "line").first()[1:] == (10, 0, 21, 2)


def test_alignment(spark):
    items = spark.createDataFrame([("p", 0), ("p", 1)], "page_id string, pos int")
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(["L0", "", "L2", " ", "L4"])], "page_id string, pos int, text string")
    found = layout.aligned(items, lines)
    assert [(r.type, r.text) for r in found.orderBy("pos").collect()] == [("line", "L0"), ("line", ""), ("vlm_extra", "L2"), ("vlm_extra", "L4")]
    assert layout.page_text(found).first().text == "L0\nL2\nL4\n"
    assert layout.page_text(found, keep_blank=True).first().text == "L0\n\nL2\nL4\n"
    assert [r.text for r in layout.aligned(items, lines, drop_blank_lines=True).orderBy("pos").collect()] == ["L0", "L2", "L4"]


def test_items(spark):
    regions = spark.createDataFrame([("p", 0, 1, 2, 30, 40), ("p", 1, 5, 60, 30, 40)], "page_id string, order int, x int, y int, w int, h int")
    lines = spark.createDataFrame([("p", 0, 1, 1, 22, 30, 10), ("p", 0, 0, 1, 2, 30, 10)], "page_id string, region_order int, line_order int, x int, y int, w int, h int")
    nested = layout.nested(regions, lines)
    assert [l.order for l in nested.first().regions[0].lines] == [0, 1]
    assert sorted((r.type, r.region_order, r.line_order, r.bbox) for r in layout.items(nested).collect() if r.type == "line") == [("line", 0, 0, [1, 2, 30, 10]), ("line", 0, 1, [1, 22, 30, 10])]
    assert layout.items(layout.nested(regions)).filter("type = 'region'").count() == 2


def test_otsu(spark):
    import numpy as np

    from pagewright.operators import image

    rng = np.random.default_rng(1)
    images = {0: rng.integers(0, 60, 300).tolist() + rng.integers(150, 255, 200).tolist(), 1: [9] * 20, 2: [1, 2, 3, 4]}
    rows = spark.createDataFrame([(k, i, int(v)) for k, own in images.items() for i, v in enumerate(own)], "image int, i int, v int")
    got = {r.image: r.threshold for r in histogram.otsu(rows, "image").collect()}
    for k, own in images.items():
        assert got[k] == image.otsu(np.array(own, np.uint8).reshape(1, -1))
    assert sorted(r.v for r in histogram.binarized(rows, "image").filter("image = 2").collect()) == [1, 2, 3, 4]
    assert {r.v for r in histogram.binarized(rows, "image").filter("image = 0").collect()} == {0, 255}
    assert (histogram.odd(4), histogram.odd(0)) == (5, 1)


def test_correction(spark):
    df, C = pages(spark, [("p", "thc cat"), ("q", None)]), models.CorrectionConfig
    assert models.corrected(df, C()).first().meta.reason == "disabled"
    assert models.corrected(df, C(enabled=True)).first().meta.reason == "pass_through"
    models.register_correction("echo", lambda config: lambda texts: ["" if t is None else t.upper() if "cat" in t else "" for t in texts])
    assert models.corrected(df, C(enabled=True, backend="echo", needs_key=True)).first().meta.reason == "missing key"
    assert [r.corrected for r in models.corrected(df, C(enabled=True, backend="echo")).collect()] == ["THC CAT", None]
    assert models.corrected(df, C(enabled=True, backend="rules", rules=(("thc", "the"),))).first().corrected == "the cat"
    with pytest.raises(RuntimeError):
        models.corrected(df, C(enabled=True, backend="nothing"))
    with pytest.raises(ValueError):
        models.correction_prompt("x", "v9")


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise RuntimeError("Error 429")

    assert models.with_retries(call, tries=3, wait=20, sleep=waits.append) is None and (len(calls), waits) == (3, [20, 40])
    assert models.with_retries(lambda: "ok") == "ok"
    assert models.is_rate_limit("RATE_LIMIT hit") and models.is_rate_limit("Quota exceeded", "gemini") and not models.is_rate_limit("quota")


def test_recognition(spark):
    rows = spark.createDataFrame([("a", b"x"), ("b", b"y")], "page_id string, image binary")
    found = models.recognize(rows, models.OcrConfig())
    assert found.columns == ["page_id", "text", "confidence"] and found.count() == 2
    assert len(models.recognize(rows, models.OcrConfig(backend="stub_page")).first().lines) == 3
    with pytest.raises(ValueError):
        models.recognize(rows, models.OcrConfig(backend="none_such"))
    with pytest.raises(NotImplementedError):
        models.recognize(rows, models.OcrConfig(backend="gemini_lines"))
    assert "secret" not in repr(models.OcrConfig(api_key="secret"))


def test_confidence(spark):
    df = spark.createDataFrame([([-0.5, -1.5],), ([],), ([2.0],)], "l array<double>")
    assert [r[0] for r in df.select(models.geometric_confidence(F.col("l"))).collect()] == [pytest.approx(0.36787944), None, 1.0]
