"""Reading and correcting by models: batches, the line reader with stand-ins for its libraries, the ledger of paid answers."""

import json
import sys
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.operators import image, ledger, models, services
from pagewright.plans.pipeline import PagePipeline
from pagewright.sources import config as C


class Tensor:
    """As much of a tensor as the reader uses, over an array."""

    def __init__(self, values):
        self.values = np.asarray(values)

    def __getitem__(self, at):
        return Tensor(self.values[at])

    def gather(self, axis, index):
        return Tensor(np.take_along_axis(self.values, index.values, axis))

    def to(self, device):
        self.device = device
        return self

    def cpu(self):
        return self

    def numpy(self):
        return self.values


class Nothing:
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


@pytest.fixture
def trocr(monkeypatch):
    """torch and transformers, of which the model reads how large and how coloured a crop is."""
    seen = types.SimpleNamespace(loaded=0, batches=[], devices=[], scores=True)
    torch = types.ModuleType("torch")
    torch.device = lambda name: name
    torch.cuda = types.SimpleNamespace(is_available=lambda: False)
    torch.inference_mode = Nothing
    torch.log_softmax = lambda t, axis: Tensor(t.values - np.log(np.exp(t.values).sum(axis, keepdims=True)))
    torch.cat = lambda parts, axis: Tensor(np.concatenate([p.values for p in parts], axis))

    class Processor:
        @classmethod
        def from_pretrained(cls, name):
            assert name == "some/model"
            return cls()

        def __call__(self, images, return_tensors):
            assert return_tensors == "pt" and all(p.ndim == 3 and p.shape[2] == 3 and p.flags.c_contiguous for p in images)
            self.images = images
            seen.batches.append(images)
            return types.SimpleNamespace(pixel_values=Tensor([[p.shape[0], p.shape[1]] for p in images]))

        def batch_decode(self, sequences, skip_special_tokens):
            assert skip_special_tokens
            return [f"{p.shape[1]}x{p.shape[0]} {p[0, 0].tolist()}" for p in self.images]

    class Model:
        @classmethod
        def from_pretrained(cls, name):
            seen.loaded += 1
            return cls()

        def to(self, device):
            seen.devices.append(device)
            return self

        def eval(self):
            return self

        def generate(self, pixels, max_new_tokens, output_scores, return_dict_in_generate):
            assert max_new_tokens == 128 and output_scores and return_dict_in_generate
            n = len(pixels.values)
            chosen = np.stack([np.zeros(n, int), np.arange(n) % 3, np.full(n, 2)], 1)  # a start, two tokens
            logits = [np.log(np.tile([0.2, 0.3, 0.5], (n, 1))) + 7, np.log(np.tile([0.1, 0.1, 0.8], (n, 1)))]
            return types.SimpleNamespace(sequences=Tensor(chosen), scores=tuple(map(Tensor, logits)) if seen.scores else ())

    transformers = types.ModuleType("transformers")
    transformers.TrOCRProcessor, transformers.VisionEncoderDecoderModel = Processor, Model
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "transformers", transformers)
    services._trocr.cache_clear()
    yield seen
    services._trocr.cache_clear()


CONFIG = models.OcrConfig(backend="trocr", model_name="some/model", device="cuda")


def test_line_reader(trocr):
    read = services.line_reader(CONFIG)
    grey, colour = np.full((20, 30), 9, np.uint8), np.zeros((22, 50, 3), np.uint8)
    colour[..., 0], colour[..., 2] = 1, 200  # blue, red
    (first, p), (second, q), (_, r) = read([image.png(grey), image.png(colour), image.png(grey)])
    assert (first, second) == ("30x20 [9, 9, 9]", "50x22 [200, 0, 1]")  # red first, as the processor takes it
    assert [p, q, r] == pytest.approx([(c * 0.8) ** 0.5 for c in (0.2, 0.3, 0.5)])
    assert read([]) == [] and len(trocr.batches) == 1 and trocr.devices == ["cpu"]  # without CUDA there is no such device
    trocr.scores = False
    assert read([image.png(grey)]) == [("30x20 [9, 9, 9]", None)]


def test_a_worker_loads_one_model(trocr):
    run = models._recognizer(CONFIG, services.line_reader, "line")
    part = pd.DataFrame({"pos": range(6), "image": [image.png(np.full((20, 30 + i), i, np.uint8)) for i in range(6)]})
    for _ in range(3):  # partitions, one after the other
        found = pd.concat(run(iter([part.iloc[:1], part.iloc[1:]])))
        assert dict(zip(found["pos"], found["text"], strict=True)) == {i: f"{30 + i}x20 [{i}, {i}, {i}]" for i in range(6)}
    assert trocr.loaded == 1
    assert list(run(iter([part.iloc[:0]]))) == []


def test_crops_go_in_full_batches_of_one_width():
    rng = np.random.default_rng(1)
    wide = rng.integers(10, 900, 403)
    rows = pd.DataFrame({"pos": range(403), "image": [image.png(np.zeros((2, w), np.uint8)) for w in wide]})
    cuts = np.r_[0, np.sort(rng.integers(0, 403, 50)), 403]  # Spark's batches are of any size
    made = list(models._line_batches((rows.iloc[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), 8))
    assert sorted(p for b in made for p in b["pos"]) == list(range(403))
    assert [len(b) for b in made[:-1]] == [8] * (len(made) - 1) and len(made[-1]) == 403 % 8
    spans = [np.ptp([models._across(x) for x in b["image"]]) for b in made]
    assert np.median(spans) < 120  # of 890
    heavy = pd.DataFrame({"pos": range(40), "image": [b"x" * 1_000_000] * 40})
    held = list(models._line_batches(iter([heavy]), 4))
    assert [len(b) for b in held] == [4] * 10 and list(models._line_batches(iter([]), 4)) == []


def test_short_answers_are_errors():
    part = pd.DataFrame({"text": ["a", "b"], "image": [b"x", b"y"]})
    for run in (models._recognizer(models.OcrConfig(), lambda c: lambda x: x[:1], "page"), models._recognizer(models.OcrConfig(), lambda c: lambda x: [("t", 1.0)], "line"), models._corrector(models.CorrectionConfig(), lambda c: lambda x: x[:1])):
        with pytest.raises(RuntimeError, match="2 .* gave 1"):
            list(run(iter([part])))


def counting(mark, fail_at):
    """A service whose calls are counted in a file that all tasks see; a task dies at the call with that number."""

    class Client:
        def __init__(self):
            self.chat = self.completions = self

        def create(self, model, messages, **_):
            with open(mark, "a") as out:
                out.write(messages[0]["content"][-3:] + "\n")
            if len(open(mark).read().split()) == fail_at:
                raise SystemExit("killed")
            return types.SimpleNamespace(choices=[types.SimpleNamespace(message=types.SimpleNamespace(content=messages[0]["content"][-3:].upper()))])

    return lambda config: services.corrector("groq", lambda key: Client())(config)


def test_a_killed_task_pays_for_nothing_twice(spark, tmp_path):
    pages = spark.createDataFrame([(f"p{i}", f"t{i:02d}") for i in range(20)], "page_id string, text string")
    config = models.CorrectionConfig(enabled=True, backend="paid", api_key="k", needs_key=True, ledger=f"file://{tmp_path}/ledger", calls=1)
    mark = tmp_path / "mark"
    models.register_correction("paid", counting(str(mark), 13))
    with pytest.raises(Exception):  # noqa: B017  the worker is gone
        models.corrected(pages, config).collect()
    assert len(mark.read_text().split()) == 13
    models.register_correction("paid", counting(str(mark), -1))
    for _ in range(2):
        found = models.corrected(pages, config)
        assert found.rdd.getNumPartitions() == 1  # one call at a time
        assert sorted(r.corrected for r in found.collect()) == [f"T{i:02d}" for i in range(20)]
    asked = mark.read_text().split()
    assert len(set(asked)) == 20 and len(asked) == 21  # the call that died was not answered
    other = models.CorrectionConfig(**{**config.__dict__, "model": "another"})
    assert models.corrected(pages.limit(1), other).count() == 1 and len(list((tmp_path / "ledger").rglob("*.json"))) == 21


def test_ledger(tmp_path):
    book, asked = ledger.Ledger(str(tmp_path)), []
    ask = lambda said: lambda: asked.append(said) or said
    assert book.answer("s", "m", "p", None, ask(None)) is None and book.answer("s", "m", "p", None, ask("")) == "" and book.answer("s", "m", "p", None, ask("new")) == ""
    for service, model, prompt, picture in (("s", "m", "p", b""), ("s", "mp", "", None), ("sm", "", "p", None), ("s", "m", "p", b"x")):
        assert book.answer(service, model, prompt, picture, ask(f"{service}{model}ä")) == f"{service}{model}ä"
    assert len(asked) == 6 and ledger.Ledger().answer("s", "m", "p", None, ask("x")) == "x"
    assert {json.loads(p.read_text())["service"] for p in tmp_path.rglob("*.json")} == {"s", "sm"}


def test_a_stage_keeps_its_ledger(spark, tmp_path):
    """The llm stage's calls of a run that died before its table was written aren't repeated, unless it is forced."""
    page = np.full((240, 400), 240, np.uint8)
    page[40:90, 30:300] = 10
    pages = spark.createDataFrame([(f"d_p000{i}", 240, 400, bytearray(page.tobytes())) for i in range(3)], "page_id string, h int, w int, data binary")
    mark = tmp_path / "mark"
    models.register_ocr("named", "line", lambda config: lambda crops: [(f"line {len(c)}", 1.0) for c in crops])
    models.register_correction("paid", counting(str(mark), -1))
    config = {"preprocessing": {"denoise": {"enabled": False}, "clahe": {"enabled": False}, "binarize": {"method": "otsu"}}, "text_detection": {"min_region_area": 1000}, "ocr": {"backend": "named"}, "llm": {"enabled": True, "backend": "paid", "calls": 1}}
    pipe = PagePipeline(spark, C.typed(config), str(tmp_path / "run"), pages=pages)
    pipe(["pdf_to_images", "preprocess", "detect", "ocr"])
    assert pipe(["llm"])["llm"].count() == 3 and len(mark.read_text().split()) == 1  # three pages with one text
    lost = PagePipeline(spark, C.typed(config), str(tmp_path / "run"), pages=pages)
    lost.tables["llm"] = []
    assert lost(["llm"])["llm"].count() == 3 and len(mark.read_text().split()) == 1
    forced = PagePipeline(spark, C.typed({**config, "runner": {"force": True}}), str(tmp_path / "run"), pages=pages)
    assert forced(["llm"])["llm"].count() == 3 and len(mark.read_text().split()) == 2


def test_colours_reach_the_filters(spark, tmp_path):
    """Without the grey step a rendered page is denoised colour by colour."""
    rng = np.random.default_rng(3)
    page = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    rows = spark.createDataFrame([("a", 40, 50, bytearray(image.to_gray(page).tobytes()), bytearray(image.png(page))), ("b", 40, 50, bytearray(image.to_gray(page).tobytes()), None)], "page_id string, h int, w int, data binary, image binary")
    keep = image.Preprocessing(grayscale=False, clahe=False, binarize=None)
    got = {r.page_id: bytes(r.data) for r in image.map_pages(rows, lambda x: image.preprocess(x, keep), "image").collect()}
    assert got["a"] == image.preprocess(page, keep).tobytes() and got["b"] == image.preprocess(image.to_gray(page), keep).tobytes() and got["a"] != got["b"]
    assert image.map_pages(rows, lambda x: image.preprocess(x, keep)).filter(F.col("data") == F.lit(got["b"])).count() == 2
