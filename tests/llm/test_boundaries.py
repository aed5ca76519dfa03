"""The rest of the library must not know of this subpackage."""

from pathlib import Path

import quipwright


def test_nothing_else_imports_it():
    root = Path(quipwright.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quipwright.llm" not in path.read_text(), path
