"""Pages of PDF files by the Poppler programs, where they are installed; a folder may be named that holds them."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable


def _program(name: str, folder: str | None) -> str:
    found = shutil.which(name, path=folder)
    if not found:
        raise RuntimeError(f"{name} of Poppler isn't installed here{f' in {folder}' if folder else ''}: install it or set pdf_to_images.poppler_path")
    return found


def _run(command: list[str], what: str) -> bytes:
    done = subprocess.run(command, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"{what}: {done.stderr.decode(errors='replace').strip()[:300]}")
    return done.stdout


def poppler(folder: str | None = None) -> tuple[Callable[[str], int], Callable[[str, int, int], bytes]]:
    """(count, render) for ``pages.register_renderer``: of a local file. A page is written to the task's own temporary
    folder for the call."""

    def count(path: str) -> int:
        said = _run([_program("pdfinfo", folder), path], "a PDF file can't be read")
        if not (found := re.search(rb"^Pages:\s+(\d+)", said, re.M)):
            raise RuntimeError("a PDF file doesn't say how many pages it has")
        return int(found[1])

    def render(path: str, page: int, dpi: int) -> bytes:
        program = _program("pdftocairo", folder)
        with tempfile.TemporaryDirectory() as own:
            _run([program, "-png", "-r", str(dpi), "-f", str(page), "-l", str(page), "-singlefile", path, os.path.join(own, "page")], f"page {page} can't be rendered")
            with open(os.path.join(own, "page.png"), "rb") as made:
                return made.read()

    return count, render
