"""Backends that call a model: TrOCR for line crops, three services that read whole pages and correct texts.

Their libraries are optional and imported where a backend is made, on the worker that runs it. A service gets one call a
page or text; when it says that it is called too often, the call is repeated after a growing pause (``models.with_retries``).
A page whose calls fail has no lines, a text whose calls fail stays as it is. A key comes from the configuration or from the
service's usual variable in the environment; without one a page backend is an error and a correction is skipped.
"""

from __future__ import annotations

import base64
import functools
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from pagewright.operators import image, models
from pagewright.operators.ledger import Ledger

#: Models used where none is named, and what a call may answer at most.
TROCR_MODEL = "microsoft/trocr-base-printed"
LINE_TOKENS, PAGE_TOKENS = 128, 4096
#: Pixels across of a page that is sent, at most; and of either side for the service with a box limit.
MOST_WIDE, MOST_SIDE = 2000, 1568


def fit_width(w: int, h: int) -> tuple[int, int]:
    return (MOST_WIDE, int(h * (MOST_WIDE / w))) if w > MOST_WIDE else (w, h)


def fit_box(w: int, h: int) -> tuple[int, int]:
    scale = min(1.0, MOST_SIDE / w, MOST_SIDE / h)
    return int(w * scale), int(h * scale)


def fitted(raw: bytes, fit: Callable[[int, int], tuple[int, int]]) -> bytes:
    """A PNG no larger than a service takes."""
    page = image.decode(raw)
    h, w = page.shape[:2]
    across, down = (max(1, n) for n in fit(w, h))
    return raw if (across, down) == (w, h) and raw[:4] == b"\x89PNG" else image.png(image.resize(page, across, down))


def data_url(raw: bytes) -> str:
    return "data:image/png;base64," + base64.b64encode(raw).decode()


def _chat(client, model: str, prompt: str, picture: bytes | None, detail: dict) -> str:
    """One question to a service with a chat interface."""
    content = prompt
    if picture is not None:
        content = [{"type": "image_url", "image_url": {"url": data_url(picture), **detail}}, {"type": "text", "text": prompt}]
    said = client.chat.completions.create(model=model, messages=[{"role": "user", "content": content}], max_tokens=PAGE_TOKENS, temperature=0.0)
    return said.choices[0].message.content or ""


def _connect_openai(key: str):
    from openai import OpenAI

    return OpenAI(api_key=key)


def _connect_groq(key: str):
    from groq import Groq

    return Groq(api_key=key)


def _connect_gemini(key: str):
    """The present library's client; of its forerunner the module stands for one."""
    try:
        from google import genai

        return genai.Client(api_key=key)
    except ImportError:
        import google.generativeai as older

        older.configure(api_key=key)
        return older


def _ask_gemini(client, model: str, prompt: str, picture: bytes | None) -> str:
    older = hasattr(client, "GenerativeModel")
    contents: list = [prompt]
    if picture is not None and older:
        contents.append({"mime_type": "image/png", "data": picture})
    elif picture is not None:
        contents.append({"inline_data": {"mime_type": "image/png", "data": picture}})
    said = client.GenerativeModel(model).generate_content(contents) if older else client.models.generate_content(model=model, contents=contents)
    return said.text or ""


@dataclass(frozen=True)
class Service:
    """How a service is reached and asked, how long its pauses are, and what its models are called."""

    name: str
    wait: float
    connect: Callable
    ask: Callable
    fit: Callable[[int, int], tuple[int, int]]
    page_model: str
    text_model: str

    @property
    def variable(self) -> str:
        return f"{self.name.upper()}_API_KEY"

    def key(self, given: str) -> str:
        return given or os.environ.get(self.variable, "")

    def answer(self, client, model: str, prompt: str, picture: bytes | None = None, sleep: Callable[[float], None] = time.sleep, ledger: Ledger = Ledger()) -> str | None:  # noqa: B008  frozen
        """The service's answer, out of the ledger where it is kept there; None where its calls fail."""
        return ledger.answer(self.name, model, prompt, picture, lambda: models.with_retries(lambda: self.ask(client, model, prompt, picture), self.name, 3, self.wait, sleep))


#: The services' default models, and seconds of the first pause.
SERVICES = {
    s.name: s
    for s in (
        Service("gemini", 30.0, _connect_gemini, _ask_gemini, fit_width, "gemini-2.0-flash-lite", "gemini-2.0-flash-lite"),
        Service("openai", 20.0, _connect_openai, lambda c, m, p, i: _chat(c, m, p, i, {"detail": "high"}), fit_width, "gpt-4o-mini", "gpt-4o-mini"),
        Service("groq", 20.0, _connect_groq, lambda c, m, p, i: _chat(c, m, p, i, {}), fit_box, "llama-3.2-11b-vision-preview", "llama-3.3-70b-versatile"),
    )
}


def page_reader(name: str, connect: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """A factory of a page backend: from PNG pages to their lines."""
    service = SERVICES[name]

    def factory(config: models.OcrConfig):
        key = service.key(config.api_key)
        if not key:
            raise ValueError(f"{name} needs a key: {name}_api_key or {service.variable}")
        client, model = (connect or service.connect)(key), config.model_name or service.page_model

        def read(pages: list[bytes]) -> list[list[str]]:
            return [(service.answer(client, model, models.PAGE_PROMPT, fitted(x, service.fit), sleep, Ledger(config.ledger)) or "").splitlines() for x in pages]

        return read

    return factory


def corrector(name: str, connect: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """A factory of a correction backend: from texts to corrected texts, None where there is no answer."""
    service = SERVICES[name]

    def factory(config: models.CorrectionConfig):
        client, model = (connect or service.connect)(service.key(config.api_key)), config.model or service.text_model

        def correct(texts: list[str]) -> list[str | None]:
            prompts = (models.correction_prompt(x, config.prompt_version) for x in texts)
            return [(service.answer(client, model, p, None, sleep, Ledger(config.ledger)) or "").strip() or None for p in prompts]

        return correct

    return factory


@functools.lru_cache(maxsize=1)
def _trocr(name: str, asked: str):
    """(processor, model, device), loaded once a worker process: it runs one task after the other."""
    import torch
    from transformers import TrOCRProcessor, VisionEncoderDecoderModel

    device = torch.device(asked if torch.cuda.is_available() else "cpu")
    return TrOCRProcessor.from_pretrained(name), VisionEncoderDecoderModel.from_pretrained(name).to(device).eval(), device


def line_reader(config: models.OcrConfig):
    """TrOCR: from line crops to (text, confidence); the confidence is the geometric mean of the chosen tokens' chances."""
    processor, model, device = _trocr(config.model_name or TROCR_MODEL, config.device)
    import torch

    def read(crops: list[bytes]) -> list[tuple[str, float | None]]:
        if not crops:
            return []
        pictures = [image.decode(x) for x in crops]
        colour = [np.repeat(p[..., None], 3, 2) if p.ndim == 2 else p[..., ::-1] for p in pictures]
        with torch.inference_mode():
            pixels = processor(images=[np.ascontiguousarray(p) for p in colour], return_tensors="pt").pixel_values.to(device)
            made = model.generate(pixels, max_new_tokens=LINE_TOKENS, output_scores=True, return_dict_in_generate=True)
        texts = processor.batch_decode(made.sequences, skip_special_tokens=True)
        if not made.scores:
            return [(t, None) for t in texts]
        steps = [torch.log_softmax(s, -1).gather(-1, made.sequences[:, i + 1 : i + 2]) for i, s in enumerate(made.scores)]
        return list(zip(texts, map(models.confidence, torch.cat(steps, 1).cpu().numpy()), strict=True))

    return read


def register() -> None:
    """Make the backends known by name."""
    models.register_ocr("trocr", "line", line_reader)
    for name in SERVICES:
        models.register_ocr(f"{name}_page", "page", page_reader(name))
        models.register_correction(name, corrector(name))


register()
