"""Python programs on an engine: db_query, db_insert, db_measurements and db_fields are theirs."""

from __future__ import annotations

import code
import contextlib
import io

from tidemark.session import Engine


def names(engine: Engine) -> dict[str, object]:
    return {f: getattr(engine, f) for f in ("db_query", "db_insert", "db_measurements", "db_fields")} | {"__name__": "__main__"}


def run(engine: Engine, text: str) -> list[str]:
    """The lines that a program prints. What it raises is the caller's."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        exec(compile(text, "<script>", "exec"), names(engine))  # noqa: S102 - the programs are the operator's own
    return out.getvalue().splitlines()


def one(engine: Engine, text: str) -> None:
    """A line of a program; an expression's value is shown."""
    console = code.InteractiveInterpreter(names(engine))
    console.runsource(text, "<expression>", "single")


def repl(engine: Engine) -> None:
    code.interact("Python on the engine: db_query(), db_insert(), db_measurements(), db_fields(). Ctrl-D ends.", local=names(engine), exitmsg="")
