"""``python -m curvelake run|status|refresh|scan|shell``."""

from __future__ import annotations

import argparse
import sys

from curvelake.errors import FieldError


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="curvelake")
    p.add_argument("command", choices=("run", "status", "refresh", "scan", "shell"))
    p.add_argument("what", nargs="?", help="a script for run, a name otherwise")
    p.add_argument("--project", "-p", default="project.toml")
    p.add_argument("--trust", action="store_true", help="allow the project's plugins")
    p.add_argument("--full", action="store_true")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    from curvelake.session import Session
    from curvelake.shell import Shell

    try:
        s = Session(None, a.project, a.trust)
        shell = Shell(s)
        if a.command == "run":
            with open(a.what) as f:
                lines = shell.run_script(f.read())
        elif a.command == "status":
            lines = s.status_lines(a.what)
        elif a.command == "refresh":
            lines = s.refresh(a.what, a.full, a.force)
        elif a.command == "scan":
            lines = s.rescan(a.what)
        else:
            lines = []
            while not shell.done:
                try:
                    print("\n".join(shell.execute(input("> ").strip() or "ls")))
                except FieldError as e:
                    print(e)
                except EOFError:
                    break
        print("\n".join([*s.warnings, *lines]))
        return 0
    except FieldError as e:
        print(e, file=sys.stderr)
        return 1
