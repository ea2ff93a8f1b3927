"""Commands as lines of text, for scripts and for a prompt."""

from __future__ import annotations

import os
import re

from curvelake.errors import FieldError

from curvelake.session import Session
from curvelake.sources import guess as guessing

ASSIGN = re.compile(r"^([A-Za-z_]\w*)\s*=(?!=)\s*(.+)$")
HELP = (
    "load reload guess new edit scan ls info values show explain del save export status refresh pin unpin plot set unset run py help quit invalidate why gc; "
    "NAME = EXPR; or an expression.  Clauses: where TESTS, with SETTING=VALUE, limit N."
)


def clauses(text: str) -> tuple[str, str, dict[str, str], int | None]:
    """An expression with its ``where``, ``with`` and ``limit``."""
    parts = re.split(r"\s+(where|with|limit)\s+", " " + text)
    where, settings, limit = "", {}, None
    for k, v in zip(parts[1::2], parts[2::2], strict=True):
        if k == "where":
            where = v.strip()
        elif k == "limit":
            limit = int(v)
        else:
            settings |= {a.strip(): b.strip() for a, b in (x.split("=", 1) for x in re.split(r",\s*(?=\w+\s*=)", v))}
    return parts[0].strip(), where, settings, limit


class Shell:
    """Runs one statement at a time and returns its lines."""

    def __init__(self, session: Session):
        self.s, self.done = session, False

    def run_script(self, text: str) -> list[str]:
        out, line = [], ""
        for part in text.splitlines():
            part = part.split(" #")[0].rstrip() if not part.lstrip().startswith("#") else ""
            if part.endswith("\\"):
                line += part[:-1] + " "
                continue
            line += part
            if line.strip():
                out += self.execute(line.strip())
            line = ""
        return out

    def execute(self, text: str) -> list[str]:
        flags = set(re.findall(r"\s--([\w-]+)", text))
        plain = re.sub(r"\s--[\w-]+", "", text).strip()
        word, _, rest = plain.partition(" ")
        rest = rest.strip()
        known = word in HELP.split(";")[0].split()
        m = ASSIGN.match(plain)
        if m and not (known and "=" not in word and rest and not rest.startswith("=")):
            e, _, settings, _ = clauses(m[2])
            return [f"{m[1]} {self.s.define(m[1], e, **settings).type}"]
        if known and not (rest.startswith((".", "+", "-", "*", "/", "^")) and word not in ("set",)):
            return getattr(self, f"do_{word}")(rest, flags)
        return self.do_show(plain, flags)

    def do_show(self, rest: str, flags: set[str]) -> list[str]:
        e, where, settings, limit = clauses(rest)
        f = self.s.field(e, where, **settings)
        f.ctx.run_checks()
        names = f.type.ins
        rows = f.df.orderBy(*[f"`{n}`" for n in names]) if names else f.df
        lines = [str(f.type)]
        got = rows.limit(20 if limit is None else limit).collect()
        lines.append("  ".join(f.type.ins + f.type.outs))
        lines += ["  ".join("nan" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in got]
        return lines + (f.ctx.report() if self.s.settings["report"] != "off" else [])

    def do_load(self, rest, flags):
        path, _, name = rest.partition(" as ")
        if not self.s.project and path.endswith("project.toml"):
            self.s.folder = os.path.dirname(os.path.abspath(path))
        self.s.load(path.strip(), name.strip() or None)
        return self.s.warnings

    def do_reload(self, rest, flags):
        self.s.__init__(self.s.spark, self.s.project, self.s.trust)
        return []

    def do_guess(self, rest, flags):
        return guessing.to_toml(guessing.guess(self.s.spark, os.path.join(self.s.folder, rest))).splitlines()

    def do_new(self, rest, flags):
        m = re.fullmatch(r"table (\w+) from (\S+)", rest)
        if not m:
            raise FieldError("new table NAME from FOLDER")
        path = os.path.join(self.s.folder, "tables", f"{m[1]}.toml")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(guessing.to_toml(guessing.guess(self.s.spark, os.path.join(self.s.folder, m[2]))))
        self.s.load(path, m[1])
        return [f"table {m[1]} in {path}"]

    def do_edit(self, rest, flags):
        return [f"edit {rest} with an editor, then reload"]

    def do_scan(self, rest, flags):
        return self.s.rescan(rest or None)

    def do_ls(self, rest, flags):
        return self.s.ls_lines()

    def do_info(self, rest, flags):
        return self.s.info_lines(rest)

    def do_values(self, rest, flags):
        name, _, column = rest.rpartition(".")
        return [" ".join(map(str, self.s.values(name, column)))]

    def do_explain(self, rest, flags):
        e, where, settings, _ = clauses(rest)
        return self.s.explain(e, where, **settings)

    def do_del(self, rest, flags):
        if rest not in self.s.variables:
            raise FieldError(f"no variable {rest}")
        del self.s.variables[rest]
        return []

    def do_save(self, rest, flags):
        e, where, settings, _ = clauses(rest)
        name, _, path = e.partition(" as ")
        return self.s.save(name.strip(), path.strip() or None, where, settings.get("grid"), settings.get("format"), settings.get("unit"), "recipe-only" in flags, "view" in flags)

    def do_export(self, rest, flags):
        e, _, path = rest.rpartition(" to ")
        e, where, settings, _ = clauses(e)
        return [f"{self.s.export(e, os.path.join(self.s.folder, path.strip()), where, **settings)} rows in {path.strip()}"]

    def do_status(self, rest, flags):
        return self.s.status_lines(rest or None)

    def do_refresh(self, rest, flags):
        return self.s.refresh(rest or None, "full" in flags, "force" in flags)

    def do_pin(self, rest, flags):
        self.s.pin(rest)
        return []

    def do_unpin(self, rest, flags):
        self.s.pin(rest, False)
        return []

    def do_plot(self, rest, flags):
        return [self.s.plot(rest)]

    def do_set(self, rest, flags):
        if not rest:
            return self.s.settings_lines()
        key, _, value = rest.partition(" ")
        self.s.set_setting(key, value.removeprefix("=").strip())
        return []

    def do_unset(self, rest, flags):
        self.s.unset_setting(rest)
        return []

    def do_run(self, rest, flags):
        with open(os.path.join(self.s.folder, rest)) as f:
            return self.run_script(f.read())

    def do_py(self, rest, flags):
        return [repr(eval(rest, {"s": self.s}))]  # noqa: S307  the user's own line

    def do_help(self, rest, flags):
        return [HELP]

    def do_quit(self, rest, flags):
        self.done = True
        return []

    def do_invalidate(self, rest, flags):
        e, where, _, _ = clauses(rest)
        return self.s.invalidate(e, where)

    def do_why(self, rest, flags):
        return self.s.why(rest)

    def do_gc(self, rest, flags):
        return self.s.gc()


__all__ = ["Shell", "clauses"]
