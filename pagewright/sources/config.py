"""Run configuration: YAML on the driver, environment variables expanded, keys redacted when written."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pagewright.operators.image import Preprocessing
from pagewright.operators.models import CorrectionConfig, OcrConfig
from pagewright.operators.page import Detection
from pagewright.operators.services import SERVICES
from pagewright.sources import files

#: The stages in the order in which they run, and words that stand for all.
STAGES = ("pdf_to_images", "preprocess", "detect", "ocr", "llm", "eval")
ALL = {"", "all", "*"}
_SECRET = re.compile(r"(key|token|secret|password)$", re.I)


def expand(value):
    """Values with ${NAME} replaced from the environment (an unset name gives an empty string)."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
    return value


def redact(value):
    if isinstance(value, dict):
        return {k: "***" if isinstance(v, str) and v and _SECRET.search(str(k)) else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list) else value


def load(path: str | Path) -> dict:
    import yaml

    found = yaml.safe_load(files.read(str(path)).decode())
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: the top level of a configuration is a mapping")
    return expand(found)


def save(config: dict, path: str | Path) -> None:
    import yaml

    files.write(str(path), yaml.safe_dump(redact(config), sort_keys=False, allow_unicode=True).encode())


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def run_id(given: str | None = None) -> str:
    """The given id, or one from local time with microseconds, so that two runs of a second differ."""
    return given or datetime.now().strftime("%Y%m%d_%H%M%S_%f")


def parse_stages(text: str | None) -> list[str]:
    """Stages of a comma list, in the order in which they run."""
    plain = (text or "").strip().lower()
    if plain in ALL:
        return list(STAGES)
    asked = {x.strip() for x in plain.split(",") if x.strip()}
    if unknown := sorted(asked - set(STAGES)):
        raise ValueError(f"no such stages: {', '.join(unknown)}")
    return [s for s in STAGES if s in asked]


@dataclass(frozen=True)
class Rendering:
    dpi: int = 300
    image_format: str = "png"
    poppler_path: str | None = None


@dataclass(frozen=True)
class Normalization:
    enabled: bool = False
    strip: bool = True
    collapse: bool = True


@dataclass(frozen=True)
class Run:
    """The typed form of a configuration."""

    raw: dict = field(default_factory=dict)
    inputs: dict = field(default_factory=dict)
    rendering: Rendering = Rendering()
    preprocessing: Preprocessing = Preprocessing()
    detection: Detection = Detection()
    ocr: OcrConfig = OcrConfig()
    correction: CorrectionConfig = CorrectionConfig()
    evaluation: Normalization = Normalization()
    run_id: str | None = None
    results_dir: str = "results"
    resume: bool = True
    force: bool = False
    files: bool = True
    part_pages: int = 50_000
    warnings: tuple[str, ...] = ()


def _section(config: dict, name: str) -> dict:
    found = config.get(name) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{name} must be a mapping")
    return found


def typed(config: dict, **override) -> Run:
    """A Run from a mapping; overrides that are None leave the configuration's value."""
    p, t, o, c, e, r = (_section(config, n) for n in ("preprocessing", "text_detection", "ocr", "llm", "evaluation", "runner"))
    denoise, clahe, binarize = (_section(p, n) for n in ("denoise", "clahe", "binarize"))
    on = lambda part, default=True: bool(part.get("enabled", default))
    norm = _section(e, "normalization")
    vendor = lambda part: str(part.get("backend", "")).split("_")[0]
    key = lambda part: SERVICES[vendor(part)].key(part.get(f"{vendor(part)}_api_key") or "") if vendor(part) in SERVICES else ""
    runner = {**r, **{k: v for k, v in override.items() if v is not None}}
    known = {"reading_order", "min_region_area", "line_segmentation"}
    return Run(
        raw={**config, "runner": runner},
        inputs=_section(config, "inputs"),
        rendering=Rendering(**{k: v for k, v in _section(config, "pdf_to_images").items() if k in ("dpi", "image_format", "poppler_path")}),
        preprocessing=Preprocessing(
            grayscale=bool(p.get("grayscale", True)), denoise=denoise.get("method", "median") if on(denoise) else None, denoise_size=int(denoise.get("ksize", 3)), clahe=on(clahe), clip_limit=float(clahe.get("clip_limit", 2.0)),
            grid=tuple(clahe.get("tile_grid_size", (8, 8))), binarize=binarize.get("method", "adaptive") if on(binarize) else None, deskew=on(_section(p, "deskew"), False),
        ),
        detection=Detection(t.get("reading_order", "single_column"), int(t.get("min_region_area", 5000)), on(_section(t, "line_segmentation"), False)),
        ocr=OcrConfig(backend=o.get("backend", "trocr"), model_name=o.get(f"{vendor(o)}_model") or ("" if vendor(o) in SERVICES else o.get("model_name", "")), device=o.get("device", "cpu"), batch_size=int(o.get("batch_size", 4)), api_key=key(o), calls=int(o.get("calls", 0))),
        correction=CorrectionConfig(
            enabled=on(c, False), backend=c.get("backend", "pass_through"), model=c.get(f"{vendor(c)}_model", ""), prompt_version=c.get("prompt_version", "v1"), api_key=key(c), needs_key=vendor(c) in SERVICES, rules=tuple(map(tuple, c.get("rules", ()))), calls=int(c.get("calls", 0)),
        ),
        evaluation=Normalization(on(e, False), bool(norm.get("strip", True)), bool(norm.get("collapse_whitespace", True))),
        run_id=runner.get("run_id"), results_dir=runner.get("results_dir", "results"), resume=bool(runner.get("resume", True)), force=bool(runner.get("force", False)), files=bool(runner.get("files", True)), part_pages=int(runner.get("part_pages", 50_000)),
        warnings=tuple(f"text_detection.{k} has no effect" for k in t if k not in known),
    )
