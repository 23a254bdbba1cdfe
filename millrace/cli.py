"""``python -m millrace init [script.py]``: asks for a source and a target, writes a flow as a script, and runs it if wanted."""

from __future__ import annotations

import runpy
import sys
from collections.abc import Callable

FORMATS = ("csv", "tsv", "json", "ndjson", "xml", "xlsx", "geojson", "parquet", "sql", "datapackage")
OUTPUTS = ("csv", "json", "geojson", "xlsx", "parquet", "zip", "print")


def script(answers: dict) -> str:
    """The flow that the answers describe, as Python text."""
    options = {k: answers[k] for k in ("format", "table", "query") if answers.get(k)}
    loaded = "".join(f", {k}={v!r}" for k, v in options.items())
    steps = [f"m.load({answers['source']!r}, name={answers.get('name') or 'data'!r}{loaded})"]
    if answers.get("filter"):
        steps.append(f"m.filter_rows({answers['filter']!r})")
    if answers.get("sort"):
        steps.append(f"m.sort_rows({answers['sort'].split(',')!r})")
    target, output = answers.get("target") or "out", answers.get("output") or "print"
    if output == "print":
        steps.append("m.printer()")
    elif output == "zip":
        steps.append(f"m.dump_to_zip({target!r})")
    else:
        steps.append(f"m.dump_to_path({target!r}, format={output!r})")
    body = "".join(f"        {s},\n" for s in steps)
    return f'"""A flow."""\n\nimport millrace as m\n\n\ndef flow():\n    return m.Flow(\n{body}    )\n\n\nif __name__ == "__main__":\n    flow().process()\n'


def ask(read: Callable[[str], str] = input) -> dict:
    """Answers to the questions; an empty one leaves the choice open."""
    answers = {"source": read("Source (path, URL or env://NAME): ").strip()}
    answers["format"] = read(f"Format ({', '.join(FORMATS)}; empty: by name): ").strip()
    if answers["format"] == "sql":
        answers["table"] = read("Table: ").strip()
    answers["name"] = read("Name: ").strip()
    answers["filter"] = read("Filter (SQL, empty: none): ").strip()
    answers["sort"] = read("Sort by (fields, by comma; empty: none): ").strip()
    answers["output"] = read(f"Output ({', '.join(OUTPUTS)}): ").strip()
    if answers["output"] not in ("", "print"):
        answers["target"] = read("Target path: ").strip()
    if not answers["source"] or answers["format"] not in ("", *FORMATS) or answers["output"] not in ("", *OUTPUTS):
        raise SystemExit("a source, a known format and a known output are needed")
    return answers


def main(args: list[str], read: Callable[[str], str] = input) -> int:
    if not args or args[0] != "init":
        print(__doc__)
        return 2
    path = args[1] if len(args) > 1 else "flow.py"
    text = script(ask(read))
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    if read(f"{path} is written. Run it (y/n)? ").strip().lower().startswith("y"):
        runpy.run_path(path, run_name="__main__")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
