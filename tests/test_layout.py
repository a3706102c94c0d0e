import ast
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.module or ""


def test_nothing_imports_the_text_subpackage():
    own = "weftline.llm"
    for path in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "weftline").parts:
            assert not [m for m in imported(path) if m.startswith(own)], path


def test_the_entry_works_without_it(monkeypatch):
    for name in ("weftline.llm", "weftline.llm.registry", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as e

    assert "reduce_by_key" in e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
    monkeypatch.delitem(sys.modules, "__spark_entry__")
