"""The driver's entry points, with and without the optional subpackage."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def say(folder, extra=""):
    out = subprocess.run([sys.executable, "-c", extra + SAY], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, check=True)
    return out.stdout.split()


def copied(tmp_path):
    for name in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        source, to = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, to, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, to)
    return tmp_path


def test_core_queries_without_the_optional_part(tmp_path):
    folder = copied(tmp_path)
    shutil.rmtree(folder / "tidemark/llm", ignore_errors=True)
    n, sql, ops, pipeline = say(folder)
    assert int(n) == int(sql) > 130 and ops == "0" and pipeline == "False"
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    assert say(folder) == [n, sql, ops, pipeline]


def test_core_queries_without_a_library(tmp_path):
    hide = "import sys; sys.modules['xxhash'] = None; "
    n, sql, ops, _ = say(copied(tmp_path), hide)
    assert int(n) == int(sql) > 130 and ops == "0"


def test_every_query_has_sql_but_models():
    import __spark_entry__ as e

    without = set(e.queries()) - set(e.oracle_sql())
    assert all(n.startswith("op") or n == "pipeline" for n in without)


def test_nothing_else_imports_the_optional_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "tidemark")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert not re.search(r"\bllm\b", f.read()), n
