"""Rewrites the coverage table of README.md from the registry: SURVEY id -> query keys.

    python tools/coverage.py
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
ORDER = "§SVFJARWOUXMEDCPT"


def rank(name: str):
    return ORDER.index(name[0]), int(re.sub(r"\D", "", name) or 0)


def main() -> None:
    from ledgerlens.plans import load_all
    from ledgerlens.plans.registry import REGISTRY
    load_all()
    keys: dict[str, set[str]] = {}
    for name, spec in REGISTRY.items():
        for i in spec.ids.split():
            keys.setdefault(i, set()).add(f"`{name}`" + ("" if spec.sql else "†"))
    rows = "".join(f"| {i} | {', '.join(sorted(keys[i]))} |\n" for i in sorted(keys, key=rank))
    path = os.path.join(ROOT, "README.md")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    start = text.index("| Id | Query keys |")
    end = text.index("\n\n", start)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text[:start] + "| Id | Query keys |\n|---|---|\n" + rows.rstrip("\n") + text[end:])


if __name__ == "__main__":
    main()
