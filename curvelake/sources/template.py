"""Path templates: ``data/U_{U}/n_{n:int}.dat``."""

from __future__ import annotations

import re

from curvelake.errors import FieldError

KINDS = {"float": (r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", float), "int": (r"[-+]?\d+", int), "str": (r"[^/]+?", str)}
HOLE = re.compile(r"\{(\w+)(?::(\w+))?\}|\*")


class Template:
    """A path pattern whose holes are typed inputs; a hole never spans a ``/``, ``*`` matches without a name."""

    def __init__(self, text: str):
        self.text = text
        self.kinds: dict[str, str] = {}
        out, at = [], 0
        for m in HOLE.finditer(text):
            out.append(re.escape(text[at : m.start()]))
            at = m.end()
            if m[0] == "*":
                out.append(r"[^/]*")
                continue
            name, kind = m[1], m[2] or "float"
            if kind not in KINDS:
                raise FieldError(f"{text}: a hole is float, int or str, not {kind}")
            if name in self.kinds:
                raise FieldError(f"{text}: {name} occurs twice")
            self.kinds[name] = kind
            out.append(f"(?P<{name}>{KINDS[kind][0]})")
        out.append(re.escape(text[at:]))
        self.regex = re.compile("".join(out))

    @property
    def fixed(self) -> str:
        """The folder above the first hole."""
        m = HOLE.search(self.text)
        return (self.text[: m.start()] if m else self.text).rpartition("/")[0]

    def match(self, path: str) -> dict | None:
        """The values of the holes in a relative path; hidden files and folders never match."""
        if any(p.startswith(".") for p in path.split("/")):
            return None
        m = self.regex.fullmatch(path)
        return {k: KINDS[self.kinds[k]][1](v) for k, v in m.groupdict().items()} if m else None
