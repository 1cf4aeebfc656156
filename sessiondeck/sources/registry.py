"""The formats that are known, by name and in the order in which a file's format is probed."""

from __future__ import annotations

import glob
import importlib.util
import os
import sys
from typing import Any

from .formats.base import Format
from .formats.claude_jsonl import ClaudeJsonl
from .formats.codex_rollout import CodexRollout
from .formats.pi_jsonl import PiJsonl
from .formats.text_export import TextExport
from .json_values import first_json_value

USER_FOLDER = os.path.join(os.path.expanduser("~"), ".sessiondeck", "formats")


def is_format(value: Any) -> bool:
    layout = getattr(value, "layout", None)
    return isinstance(getattr(value, "name", None), str) and bool(value.name) and all(callable(getattr(value, m, None)) for m in ("folder", "detect", "parse", "normalize")) and callable(getattr(layout, "match", None))


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Format] = {}

    def register(self, known: Format) -> None:
        """A name that is known keeps its place and gets the new format."""
        if not is_format(known):
            raise TypeError("not a session format")
        self._known[known.name] = known

    def get(self, name: str) -> Format | None:
        return self._known.get(name)

    def all(self) -> list[Format]:
        return list(self._known.values())

    def load_file(self, path: str) -> Format | None:
        """A module's `FORMAT`, or its `source`. None, with a warning, if there is none."""
        try:
            spec = importlib.util.spec_from_file_location(f"sessiondeck_format_{os.path.basename(path).removesuffix('.py')}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            found = getattr(module, "FORMAT", None) or getattr(module, "source", None)
            self.register(found)
        except Exception as error:  # a user's file may fail in any way
            print(f"warning: can't load format {path}: {error}", file=sys.stderr)
            return None
        return found

    def load_folder(self, folder: str) -> list[Format]:
        return [x for path in sorted(glob.glob(os.path.join(folder, "*.py"))) if (x := self.load_file(path))]

    def detect(self, text: str) -> Format | None:
        first = first_json_value(text)
        return next((x for x in self.all() if x.detect(first, text)), None)


def default_registry(extra: list[str] | None = None, user_folder: str | None = USER_FOLDER) -> Registry:
    """Built-in formats, then the user's, then those named."""
    found = Registry()
    for x in (ClaudeJsonl(), CodexRollout(), TextExport(), PiJsonl()):
        found.register(x)
    if user_folder and os.path.isdir(user_folder):
        found.load_folder(user_folder)
    for path in extra or []:
        found.load_file(path)
    return found
