"""Command line: ``python -m pleat eval SENTENCE``, ``run FILE`` or ``plan SENTENCE``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import apl, j
from .errors import LanguageError

NOTATIONS = {"j": j, "apl": apl}
#: Endings of files whose notation is known.
ENDINGS = {".j": "j", ".ijs": "j", ".apl": "apl"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pleat", description="Sentences of array notations.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, what, say in (("eval", "sentence", "show what a sentence comes to"), ("run", "file", "run a file of sentences"), ("plan", "sentence", "show how a sentence is read and planned")):
        one = commands.add_parser(name, help=say)
        one.add_argument(what)
        one.add_argument("--notation", choices=sorted(NOTATIONS), help="by default j, or what the file's ending says")
    return top


def source_of(given: argparse.Namespace) -> tuple[str, str]:
    """The program's text and notation; ``ValueError`` if either cannot be told."""
    if given.command != "run":
        return given.sentence, given.notation or "j"
    path = Path(given.file)
    notation = given.notation or ENDINGS.get(path.suffix)
    if notation is None:
        raise ValueError(f"{path.name}: its notation is not known from its ending; give --notation")
    try:
        return path.read_text(encoding="utf-8"), notation
    except OSError as e:
        raise ValueError(f"{path}: {e.strerror}") from None


def main(argv: list[str] | None = None) -> int:
    """0 if the program ran, 1 if the language refused it, 2 if there was nothing to run."""
    given = parser().parse_args(argv)
    try:
        text, notation = source_of(given)
        kernel = NOTATIONS[notation].compile(text)
        if given.command == "plan":
            print(kernel.explain())
        else:
            shown = kernel(out=sys.stdout.write, read=lambda: sys.stdin.readline().rstrip("\n"))
            if shown.value is not None:
                print(shown)
    except LanguageError as refusal:
        print(refusal, file=sys.stderr)
        return 1
    except ValueError as nothing:
        print(nothing, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
