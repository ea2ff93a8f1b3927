"""Settings, their values and defaults; four levels: statement, session, project, default."""

from __future__ import annotations

import re

from curvelake.errors import FieldError

CHOICES = {
    "extrapolate": ("nan", "error", "extend", "clamp"), "duplicates": ("error", "mean", "first", "last", "drop"), "fewpoints": ("linear", "drop", "error"),
    "unmatched": ("drop", "error"), "nan_rows": ("drop", "error"), "branches": ("error", "split"), "report": ("short", "full", "off"),
    "fingerprint": ("stat", "hash"), "cache_format": ("parquet", "npz"), "strict": ("false", "true"), "disk_cache": ("false", "true"),
}
DEFAULTS = {
    "method": "pchip", "grid": "overlap(n=200)", "extrapolate": "nan", "duplicates": "error", "fewpoints": "linear", "unmatched": "drop", "nan_rows": "drop",
    "align": "auto", "branches": "error", "flat_tol": "1e-9", "strict": "false", "report": "short", "fingerprint": "stat", "cache_format": "parquet",
    "datasets_dir": "results", "disk_cache": "false", "disk_cache_mb": "1024", "read_cache_mb": "512",
}
PLOT = {"backend": "gnuplot", "style": "lines", "cmap": "viridis", "size": "640,480", "save_script": "false"}
METHODS = re.compile(r"linear|pchip|akima|cubic|smooth\([\d.eE+-]+\)")


def check(key: str, value: str) -> str:
    """The value in plain form, or an error that lists what is allowed."""
    value = str(value).strip()
    value = value.lower() if value in ("True", "False") else value
    if key.startswith("plot."):
        if key[5:] not in PLOT:
            raise FieldError(f"no plot setting {key[5:]}; there are {', '.join(PLOT)}")
        return value
    if key not in DEFAULTS:
        raise FieldError(f"no setting {key}; there are {', '.join(DEFAULTS)}")
    if key in CHOICES and value not in CHOICES[key]:
        raise FieldError(f"{key} is one of {', '.join(CHOICES[key])}, not {value}")
    if key == "method" and not METHODS.fullmatch(value):
        raise FieldError(f"method is linear, pchip, akima, cubic or smooth(s), not {value}")
    if key in ("flat_tol", "disk_cache_mb", "read_cache_mb"):
        float(value)
    return value


class Settings:
    """Layers of settings, the last one first."""

    def __init__(self, *layers: dict[str, str]):
        self.layers = [{k: check(k, v) for k, v in layer.items()} for layer in layers]

    def __getitem__(self, key: str) -> str:
        for layer in reversed(self.layers):
            if key in layer:
                return layer[key]
        return DEFAULTS[key]

    def over(self, layer: dict[str, str]) -> Settings:
        return Settings(*self.layers, layer)

    def items(self) -> list[tuple[str, str, bool]]:
        return [(k, self[k], any(k in layer for layer in self.layers)) for k in DEFAULTS]
