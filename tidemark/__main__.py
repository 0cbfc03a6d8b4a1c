"""Command line: ``python -m tidemark lang [-e EXPR | -f FILE] [--format text|json|csv]``,
``python -m tidemark python [FILE | -e EXPR]``, ``python -m tidemark server [--port N] [--tcp-port N]
[--scripts]``, ``python -m tidemark version``."""

from __future__ import annotations

import argparse
import sys

from tidemark.render import render

VERSION = "0.1.0"


def run_lines(engine, lines, form: str, out=None) -> None:
    """One expression a line; lines that begin with / are comments; errors don't end the run."""
    out = out or sys.stdout
    for line in lines:
        line = line.strip()
        if not line or line.startswith("/"):
            continue
        if line in ("\\q", "exit"):
            return
        if line.startswith("\\fmt"):
            form = line.split()[-1] if line.split()[-1] in ("text", "json", "csv") else form
            continue
        try:
            print(render(engine.eval(line), form), file=out)
        except Exception as e:  # shown, and the next line runs
            print(f"error: {e}", file=out)


def listen(engine, root: str, port: int):
    """A TCP listener beside the store, and the stream that takes in what it spools."""
    import threading

    from tidemark.streaming.ingest import ingest, lines_from
    from tidemark.streaming.listener import Listener, Spool

    folder = root.removeprefix("file://").rstrip("/") + "/spool"
    listener = Listener(Spool(folder), port=port)
    threading.Thread(target=listener.serve_forever, daemon=True).start()
    return listener, ingest(lines_from(engine.spark, f"file://{folder}"), engine.store, f"{root.rstrip('/')}/spool-checkpoint")


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidemark")
    top.add_argument("--data", help="folder of the store")
    sub = top.add_subparsers(dest="command", required=True)
    lang = sub.add_parser("lang")
    lang.add_argument("-e", dest="expr")
    lang.add_argument("-f", dest="file")
    lang.add_argument("--format", default="text", choices=["text", "json", "csv"])
    server = sub.add_parser("server")
    server.add_argument("--port", type=int, default=8086)
    server.add_argument("--tcp-port", type=int, help="listen for line protocol as well")
    server.add_argument("--scripts", action="store_true", help="let clients run Python programs")
    python = sub.add_parser("python")
    python.add_argument("file", nargs="?")
    python.add_argument("-e", dest="expr")
    sub.add_parser("version")
    a = top.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    from pyspark.sql import SparkSession

    from tidemark.session import Engine

    engine = Engine(SparkSession.builder.appName("tidemark").getOrCreate(), a.data)
    if a.command == "server":
        from tidemark.server import serve

        if a.tcp_port is not None:
            listen(engine, a.data, a.tcp_port)
        serve(engine, port=a.port, scripts=a.scripts).serve_forever()
        return 0
    if a.command == "python":
        from tidemark import scripting

        if a.expr:
            scripting.one(engine, a.expr)
        elif a.file:
            with open(a.file, encoding="utf-8") as f:
                print("\n".join(scripting.run(engine, f.read())))
        else:
            scripting.repl(engine)
        return 0
    if a.expr:
        run_lines(engine, [a.expr], a.format)
    elif a.file:
        with open(a.file, encoding="utf-8") as f:
            run_lines(engine, f, a.format)
    else:
        run_lines(engine, sys.stdin, a.format)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
