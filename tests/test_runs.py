"""Configuration, sources, sinks, stages and resuming."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import cli
from pagewright.operators import image, layout, manifest, models, page, services
from pagewright.plans.pipeline import PagePipeline
from pagewright.sinks import artifacts
from pagewright.sources import config as C
from pagewright.sources import pages as S
from pagewright.sources import pdf
from pagewright.streaming import resume


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "hush")
    path = tmp_path / "c.yaml"
    path.write_text("llm:\n  enabled: true\n  backend: groq\n  groq_api_key: ${SOME_KEY}\ntext_detection:\n  mode: x\nrunner:\n  resume: false\n")
    run = C.typed(C.load(path))
    assert run.correction.api_key == "hush" and not run.resume and run.warnings
    assert C.typed(C.load(path), resume=True).resume
    C.save(run.raw, tmp_path / "out.yaml")
    assert "hush" not in (tmp_path / "out.yaml").read_text()
    path.write_text("- a\n")
    with pytest.raises(ValueError):
        C.load(path)
    path.write_text("")
    assert C.load(path) == {} and C.typed({}).preprocessing.denoise == "median"


def test_stages():
    assert C.parse_stages("eval, OCR") == ["ocr", "eval"] and C.parse_stages("*") == list(C.STAGES) == C.parse_stages("")
    with pytest.raises(ValueError):
        C.parse_stages("ocr,foo")
    args = cli.parse(["--config", "c"])
    assert args.force is None and args.resume is None and cli.parse(["--config", "c", "--no-resume"]).resume is False
    assert C.run_id("x") == "x" and C.run_id() != C.run_id()


def test_inputs(tmp_path):
    with pytest.raises(ValueError):
        S.list_inputs({})
    with pytest.raises(FileNotFoundError):
        S.list_inputs({"pdf_dir": "."}, tmp_path)
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [p.rsplit("/", 1)[1] for p in S.list_inputs({"pdf_dir": "."}, str(tmp_path))] == ["a.pdf", "b.pdf"]
    assert S.list_inputs({"pdfs": ["b.pdf"], "pdf_dir": "."}, str(tmp_path))[0].endswith("b.pdf")
    with pytest.raises(FileNotFoundError):
        S.list_inputs({"pdfs": ["z.pdf"]}, str(tmp_path))


def test_rendering(spark, tmp_path):
    (tmp_path / "doc.pdf").write_bytes(b"3")
    S.register_renderer("toy", lambda path: int(open(path).read()), lambda path, page, dpi: image.png(np.full((4, page), dpi % 256, np.uint8)))
    files = S.binary_files(spark, str(tmp_path), "*.pdf")
    made = S.render(files, "toy", [1, 3, 9], None, 150).orderBy("page_id").collect()
    assert [r.page_id for r in made] == ["doc_p0001", "doc_p0003"] and image.decode_png(bytes(made[1].image)).shape == (4, 3)
    with pytest.raises(RuntimeError):
        S.page_counts(files, "nothing")


def test_truth(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"document": "d", "lines": ["x", "y"]}))
    (tmp_path / "b.json").write_text(json.dumps({"p1": "eins", "p2": 7}))
    (tmp_path / "c.json").write_text(json.dumps({"p1": ["not", "text"]}))
    of = lambda n: sorted(map(tuple, S.read_truth(spark, str(tmp_path / n)).collect()))
    assert of("a.json") == [("d", "x\ny")] and of("b.json") == [("p1", "eins"), ("p2", "7")]
    assert S.read_truth(spark, None) is None
    with pytest.raises(ValueError):
        S.read_truth(spark, "x.txt")
    with pytest.raises(Exception, match="not a text"):
        of("c.json")


def test_manifest_file(spark, tmp_path):
    pages = spark.createDataFrame([("p1", ("pdf", "a.pdf", 1), {"ocr": {"text": "t"}})], S.new_manifest(spark).schema)
    pages = pages.unionByName(spark.createDataFrame([("p0", ("pdf", "ä.pdf", 2), {})], pages.schema))
    artifacts.write_manifest({"run_id": "r", "created_at": C.utc_now()}, pages, str(tmp_path / "m"))
    assert [p["page_id"] for p in json.loads((tmp_path / "m").read_text())["pages"]] == ["p0", "p1"]
    run, back = S.read_manifest(spark, str(tmp_path / "m"))
    assert run.first().config_path == "config.effective.yaml" and sorted(back.collect()) == sorted(pages.collect())
    assert back.filter(manifest.path_of(F.col("artifacts"), "ocr", "text") == "t").count() == 1
    (tmp_path / "n.json").write_text('{"run_id": "r", "created_at": "t"}')
    assert S.read_manifest(spark, str(tmp_path / "n.json"))[1].count() == 0


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", "eins"), ("b.txt", "zwei")], "name string, content string")
    assert artifacts.write_files(rows, f"file://{tmp_path}") == 2
    assert (tmp_path / "a/x.txt").read_text() == "eins"
    assert sorted(map(tuple, S.read_texts(spark, str(tmp_path / "b.txt")).collect())) == [("b", "zwei")]
    artifacts.write_json({"ä": 1}, tmp_path / "r.json")
    assert "ä" in (tmp_path / "r.json").read_text()


def scan(shift=0):
    p = np.full((240, 400), 240, np.uint8)
    for y in (40, 64, 88):
        for x in range(30, 360, 8):
            p[y + shift : y + shift + 16, x : x + 5] = 10
    return p


def drawn(spark, *shifts):
    return spark.createDataFrame([(f"d_p000{i}", 240, 400, bytearray(scan(i).tobytes())) for i in shifts], "page_id string, h int, w int, data binary")


CONFIG = {
    "preprocessing": {"denoise": {"enabled": False}, "clahe": {"enabled": False}, "binarize": {"method": "otsu"}}, "text_detection": {"line_segmentation": {"enabled": True}, "min_region_area": 1000},
    "ocr": {"backend": "seen_lines"}, "llm": {"enabled": True, "backend": "rules", "rules": [["a", "b"]]}, "evaluation": {"enabled": True},
}


def readers():
    """Backends of this module go to the workers by value, so they are made within a function."""

    def lines(config):
        """Says how large a crop is, and whether it is cut to its ink."""
        cut = lambda c: (c[:, :5] < 128).any() and (c[:, -5:] < 128).any()
        return lambda crops: [(f"{c.shape[1]}x{c.shape[0]}" + " tight" * bool(cut(c)), 0.5) for c in map(image.decode_png, crops)]

    def pages(config):
        return lambda pages: [[f"{p.shape[1]}x{p.shape[0]}", f"{p.max()} {p.min()}", " ", "and more", *["x"] * 3] for p in map(image.decode_png, pages)]

    return lines, pages


models.register_ocr("seen_lines", "line", readers()[0])
models.register_ocr("seen_pages", "page", readers()[1])


def test_pipeline_by_lines(spark, tmp_path):
    truth = spark.createDataFrame([("d_p0001", "abc"), ("d_p0009", "x")], "page_id string, text string")
    pipe = PagePipeline(spark, C.typed(CONFIG), str(tmp_path / "run"), pages=drawn(spark, 1), truth=truth, files=True)
    with pytest.raises(RuntimeError):
        pipe(["detect"])
    out = pipe(list(C.STAGES))
    assert out["eval"].first().evaluated == 1 and out["eval"].first().total_processed == 1 and pipe.metrics().count() == 1
    (region,) = out["detect"].first().regions
    lines = [(x.bbox.y, x.bbox.h) for x in region.lines]
    assert len(lines) >= 1 and all(y >= 30 for y, _ in lines)
    text = out["ocr"].first().text
    assert text.count("\n") == len([h for _, h in lines if h >= 20]) or text == "\n"
    assert all(i.text.endswith("tight") and i.confidence == 0.5 for i in out["ocr"].first().items or [])
    assert out["llm"].first().meta.backend == "rules"
    # files of a page and a manifest that names them
    folder = tmp_path / "run"
    assert (image.decode_png((folder / "images/raw/d_p0001.png").read_bytes()) == scan(1)).all()
    assert json.loads((folder / "detection/d_p0001.json").read_text())["regions"][0]["order"] == 0
    assert image.decode_png((folder / "detection/overlays/d_p0001.png").read_bytes()).shape == (240, 400, 3)
    assert sorted(p.name for p in (folder / "detection/crops/d_p0001").iterdir()) == [f"line_000_{k:03d}.png" for k in range(len(lines))]
    assert (folder / "ocr/pages/d_p0001.txt").read_text() == text and (folder / "llm/pages/d_p0001.diff").exists() and (folder / "llm/pages/d_p0001_corrected.txt").exists()
    named = {r.page_id: r.artifacts for r in pipe.manifest().collect()}
    assert named["d_p0001"]["ocr"] == {"items_json": "ocr/items/d_p0001.json", "page_text": "ocr/pages/d_p0001.txt"}
    assert all((folder / path).exists() for kinds in named["d_p0001"].values() for path in kinds.values())


def test_pipeline_by_pages(spark, tmp_path):
    config = {**CONFIG, "ocr": {"backend": "seen_pages"}}
    out = PagePipeline(spark, C.typed(config), str(tmp_path / "run"), pages=drawn(spark, 1, 2))(["pdf_to_images", "preprocess", "detect", "ocr"])
    for r in out["ocr"].collect():
        read = [i.text for i in r.items]
        assert read[0] == "400x240" and "240 10" in read  # the page as it was rendered, not as preprocessed
        assert r.text.startswith("400x240\n240 10\nand more\nx") and [i.type for i in r.items][-1] == "vlm_extra"


def test_pipeline_goes_on(spark, tmp_path):
    """New pages alone are done; a changed setting redoes its stage and those after it; a stage that lacks pages is an error."""
    first = PagePipeline(spark, C.typed(CONFIG), str(tmp_path / "run"), pages=drawn(spark, 1))
    first(["pdf_to_images", "preprocess", "detect", "ocr", "llm"])
    pages, steps = drawn(spark, 1, 2), ["pdf_to_images", "preprocess", "detect", "ocr", "llm"]
    size = lambda pipe, stage, i=-1: spark.read.parquet(pipe.tables[stage][i]).count()
    more = PagePipeline(spark, C.typed(CONFIG), str(tmp_path / "run"), pages=pages, tables=first.tables)
    assert more(steps)["llm"].count() == 2 and all(size(more, s) == 1 for s in steps)
    changed = PagePipeline(spark, C.typed({**CONFIG, "llm": {"enabled": True, "backend": "rules", "rules": [["t", "T"]]}}), str(tmp_path / "run"), pages=pages, tables=more.tables)
    assert all("T" in r.corrected for r in changed(steps)["llm"].collect() if "t" in r.text)
    assert size(changed, "ocr") == 0 and size(changed, "llm") == 2 and changed.table("llm").count() == 2
    other = PagePipeline(spark, C.typed({**CONFIG, "preprocessing": {"binarize": {"enabled": False}}}), str(tmp_path / "run"), pages=pages, tables=changed.tables)
    with pytest.raises(RuntimeError):
        other(["detect"])
    assert other(steps)["detect"].count() == 2 and size(other, "pdf_to_images") == 0 and size(other, "preprocess") == 2
    forced = PagePipeline(spark, C.typed({**CONFIG, "runner": {"force": True}}), str(tmp_path / "run"), pages=pages, tables=other.tables)
    assert forced(["pdf_to_images"])["pdf_to_images"].count() == 2 and size(forced, "pdf_to_images") == 2
    with pytest.raises(RuntimeError):
        PagePipeline(spark, C.typed(CONFIG), str(tmp_path / "run"), pages=drawn(spark, 1, 2, 3), tables=forced.tables)(["pdf_to_images", "detect"])


def test_page_detection_is_the_tables(spark):
    """The page kernels and the table operators find the same."""
    rng = np.random.default_rng(4)
    for h in (3, 8, 30, 200):
        ink = (rng.integers(0, 40, h) * np.repeat(rng.integers(0, 2, h // 8 + 1), 8)[:h]).astype(int)
        table = spark.createDataFrame([(1, y, int(v)) for y, v in enumerate(ink)], "r int, y int, ink long")
        want = [(r.y, r.y + r.h) for r in layout.segment_lines(table, "r").orderBy("y").collect()]
        assert page.line_spans(ink) == want
    boxes = [tuple(map(int, b)) for b in rng.integers(0, 60, (25, 4))]
    table = spark.createDataFrame([(1, *b) for b in boxes], "page_id int, x int, y int, w int, h int")
    for two in (False, True):
        want = [tuple(r) for r in layout.reading_order(table, two_columns=two, width=F.lit(60)).orderBy("order").select("x", "y", "w", "h").collect()]
        assert [b[:2] for b in page.ordered(boxes, two, 60)] == [b[:2] for b in want]
    crop = np.full((25, 40), 255, np.uint8)
    crop[5, 10:31] = 0
    assert page.tight(crop).shape == (25, 29) and page.tight(crop[:19]) is None and page.tight(crop[:, :14]) is None
    pixels = spark.createDataFrame([(1, y, x, int(crop[y, x])) for y in range(25) for x in range(40)], "line int, y int, x int, v int")
    assert layout.tight_crops(pixels, "line", width=F.lit(40), height=F.lit(25)).first()[1:] == (6, 35)


# --- services -------------------------------------------------------------------------------------------------------


class Asked:
    """A stand-in for a service's client: answers in turn, an exception for one that is raised."""

    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []
        self.chat = self.completions = self.models = self

    def _next(self, **given):
        self.calls.append(given)
        said = self.answers.pop(0)
        if isinstance(said, Exception):
            raise said
        return said

    def create(self, **given):
        said = self._next(**given)
        return type("Said", (), {"choices": [type("Choice", (), {"message": type("Message", (), {"content": said})})]})

    def generate_content(self, **given):
        return type("Said", (), {"text": self._next(**given)})


def test_page_services():
    wide = image.png(np.full((30, 3000), 9, np.uint8))
    for name, most in (("openai", (20, 2000)), ("groq", (15, int(3000 * (1568 / 3000)))), ("gemini", (20, 2000))):
        client, waits = Asked(RuntimeError("Error 429"), "one\ntwo", RuntimeError("broken"), None), []
        read = services.page_reader(name, lambda key: client, waits.append)(models.OcrConfig(api_key="k"))
        assert read([wide, wide, wide]) == [["one", "two"], [], []]
        assert waits == [services.SERVICES[name].wait] and len(client.calls) == 4
        call = client.calls[0]
        assert call["model"] == services.SERVICES[name].page_model
        if name == "gemini":
            raw = call["contents"][1]["inline_data"]["data"]
        else:
            picture, words = call["messages"][0]["content"]
            assert words["text"] == models.PAGE_PROMPT and call["max_tokens"] == 4096 and call["temperature"] == 0.0 and ("detail" in picture["image_url"]) == (name == "openai")
            head, _, body = picture["image_url"]["url"].partition(",")
            assert head == "data:image/png;base64"
            raw = base64.b64decode(body)
        assert image.decode_png(raw).shape == most
    small = image.png(np.full((30, 40), 9, np.uint8))
    assert services.fitted(small, services.fit_box) == small


def test_service_keys(monkeypatch):
    for name in services.SERVICES:
        monkeypatch.delenv(f"{name.upper()}_API_KEY", raising=False)
        with pytest.raises(ValueError):
            services.page_reader(name)(models.OcrConfig())
    run = C.typed({"llm": {"enabled": True, "backend": "openai"}, "ocr": {"backend": "groq_page", "groq_model": "m"}})
    assert models.skip_reason(run.correction) == "missing key" and run.ocr.model_name == "m" and run.ocr.api_key == ""
    monkeypatch.setenv("OPENAI_API_KEY", "from outside")
    assert C.typed({"llm": {"enabled": True, "backend": "openai"}}).correction.api_key == "from outside"
    assert C.typed({}).ocr.backend == "trocr" and models.ocr_kind(C.typed({}).ocr) == "line"
    with pytest.raises(NotImplementedError):
        models.ocr_kind(models.OcrConfig(backend="gemini_lines"))


def test_correction_services(spark):
    client, waits = Asked(" better ", "", RuntimeError("rate_limit"), RuntimeError("rate_limit"), RuntimeError("rate_limit")), []
    correct = services.corrector("groq", lambda key: client, waits.append)(models.CorrectionConfig(enabled=True, backend="groq", api_key="k"))
    assert correct(["a", "b", "c"]) == ["better", None, None] and waits == [20.0, 40.0]
    assert client.calls[0]["messages"][0]["content"] == models.correction_prompt("a") and client.calls[0]["model"] == "llama-3.3-70b-versatile"

    def factory(config):
        return services.corrector("groq", lambda key: Fixed())(config)

    class Fixed:
        def __init__(self):
            self.chat = self.completions = self

        def create(self, messages, **_):
            text = "" if "blank" in messages[0]["content"] else "mended"
            return type("Said", (), {"choices": [type("Choice", (), {"message": type("Message", (), {"content": text})})]})

    models.register_correction("fixed", factory)
    pages = spark.createDataFrame([("p1", "rough"), ("p2", "blank")], "page_id string, text string")
    found = models.corrected(pages, models.CorrectionConfig(enabled=True, backend="fixed", api_key="k", needs_key=True, model="m"))
    assert sorted((r.page_id, r.corrected, r.meta.model) for r in found.collect()) == [("p1", "mended", "m"), ("p2", "blank", "m")]


def test_poppler(spark, tmp_path):
    """The programs are called as they should be (stand-ins here)."""
    with pytest.raises(RuntimeError, match="isn't installed"):
        pdf.poppler(str(tmp_path))[0]("x")
    (tmp_path / "one.png").write_bytes(image.png(np.full((3, 4), 7, np.uint8)))
    for name, script in (("pdfinfo", 'grep -q broken "$1" && { echo bad >&2; exit 1; }; echo "Title: x"; echo "Pages:          3"'), ("pdftocairo", f'for last; do :; done; echo "$@" > {tmp_path}/asked; cp {tmp_path}/one.png "$last.png"')):
        (tmp_path / name).write_text(f"#!/bin/bash\n{script}\n")
        (tmp_path / name).chmod(0o755)
    count, render = pdf.poppler(f"{tmp_path}:/usr/bin:/bin")
    (tmp_path / "fine").write_bytes(b"fine")
    (tmp_path / "broken").write_bytes(b"broken")
    assert count(f"{tmp_path}/fine") == 3
    with pytest.raises(RuntimeError, match="bad"):
        count(f"{tmp_path}/broken")
    assert image.decode_png(render(f"{tmp_path}/fine", 2, 150)).shape == (3, 4)
    assert (tmp_path / "asked").read_text().startswith("-png -r 150 -f 2 -l 2 -singlefile ")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.pdf").write_bytes(b"fine")
    run = C.typed({"inputs": {"pdf_dir": str(tmp_path / "in"), "pages": [1, 3, 9]}, "pdf_to_images": {"poppler_path": f"{tmp_path}:/usr/bin:/bin"}})
    pipe = PagePipeline(spark, run, str(tmp_path / "run"))
    assert sorted(r.page_id for r in pipe(["pdf_to_images"])["pdf_to_images"].collect()) == ["doc_p0001", "doc_p0003"]
    assert pipe(["pdf_to_images"])["pdf_to_images"].count() == 2 and spark.read.parquet(pipe.tables["pdf_to_images"][-1]).count() == 0


def test_command_line(tmp_path, spark, monkeypatch):
    """A whole run from a configuration file, then again."""
    (tmp_path / "doc.pdf").write_bytes(b"x")
    page_of = scan(1)
    monkeypatch.setattr(pdf, "poppler", lambda folder=None: (lambda raw: 2, lambda raw, n, dpi: image.png(page_of)))
    (tmp_path / "truth.json").write_text(json.dumps({"doc_p0001": "x"}))
    config = {**CONFIG, "inputs": {"pdfs": [str(tmp_path / "doc.pdf")], "ground_truth": str(tmp_path / "truth.json")}, "runner": {"results_dir": str(tmp_path / "out"), "run_id": "r"}}
    (tmp_path / "c.json").write_text(json.dumps(config))  # JSON is YAML
    for _ in range(2):
        assert cli.main(["--config", str(tmp_path / "c.json")]) == 0
    out = tmp_path / "out" / "r"
    found = json.loads((out / "manifest.json").read_text())
    assert found["run_id"] == "r" and [p["page_id"] for p in found["pages"]] == ["doc_p0001", "doc_p0002"] and set(found["pages"][0]["artifacts"]) == {"pdf_to_images", "preprocess", "detect", "ocr", "llm"}
    assert json.loads((out / "metrics" / "metrics.json").read_text())["evaluated"] == 1 and "Pages evaluated: 1 of 2" in (out / "metrics" / "metrics.md").read_text()
    assert (out / "config.effective.yaml").exists() and (out / "images/raw/doc_p0002.png").exists()


@pytest.mark.parametrize("every", [1, 2, 16])
def test_stream(spark, tmp_path, every):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, at int").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: resume.upserting(resume.table_stream(spark, str(tmp_path / "in"), rows), str(tmp_path / "t"), ["k"], "at", str(tmp_path / "s"), every=every).awaitTermination()
    now = lambda n: sorted(map(tuple, resume.latest(spark, str(tmp_path / "t"), n, ["k"], "at", every).collect()))
    for _ in range(2):  # the second run has nothing new
        stream()
    for n, (k, at) in enumerate([("b", 9), ("c", 4), ("a", 2)], 1):
        spark.createDataFrame([(k, at)], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream()
        assert now(n) == now(None) == [("a", 3), ("b", 9), *([("c", 4)] * (n > 1))]
    assert now(0) == [("a", 3), ("b", 2)]
    (tmp_path / "t/d=9").mkdir()  # a batch that was begun
    assert now(None) == now(3)
    (tmp_path / "t/d=9").rmdir()
    with pytest.raises(FileNotFoundError):
        resume.latest(spark, str(tmp_path / "none"), None, ["k"], "at")
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == sorted([f"d={i}" for i in range(4)] + [f"s={i}" for i in range(4) if i % every == every - 1])
