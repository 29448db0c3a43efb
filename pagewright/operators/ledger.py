"""Answers of paid services, kept as they come.

An answer is a file of its own under the hash of what was asked (service, model, prompt, picture), written before the next
question is put. So a task that is killed, or run a second time, asks only what has no answer yet; and what two tasks ask at
the same time is the same file. Calls that fail leave nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pagewright.sources import files


@dataclass(frozen=True)
class Ledger:
    """folder: one that all machines see; empty: nothing is kept."""

    folder: str = ""

    def path(self, service: str, model: str, prompt: str, picture: bytes | None) -> str:
        asked = hashlib.sha256()
        for part in (service.encode(), model.encode(), prompt.encode(), b"" if picture is None else b"picture " + picture):
            asked.update(len(part).to_bytes(8, "big") + part)
        name = asked.hexdigest()
        return files.joined(self.folder, name[:2], name[2:4], f"{name}.json")

    def answer(self, service: str, model: str, prompt: str, picture: bytes | None, ask: Callable[[], str | None]) -> str | None:
        """The answer that is kept, or that of ask()."""
        if not self.folder:
            return ask()
        path = self.path(service, model, prompt, picture)
        if files.exists(path):
            return json.loads(files.read(path))["answer"]
        said = ask()
        if said is not None:
            files.write(path, json.dumps({"service": service, "model": model, "answer": said}, ensure_ascii=False).encode())
        return said
