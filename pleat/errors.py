"""Errors of the language, each with the sentence and the place it points at when known."""

from __future__ import annotations


class LanguageError(Exception):
    """Base of all refusals; ``source`` and ``at`` give the caret line of ``str``."""

    kind = "language error"

    def __init__(self, message: str, source: str | None = None, at: int | None = None):
        super().__init__(message)
        self.message, self.source, self.at = message, source, at

    def __str__(self) -> str:
        text = f"{self.kind}: {self.message}"
        if self.source is not None and self.at is not None:
            line = self.source[: self.at].count("\n")
            column = self.at - (self.source.rfind("\n", 0, self.at) + 1)
            text += f"\n  {self.source.splitlines()[line] if self.source else ''}\n  {' ' * column}^"
        return text


class ParseError(LanguageError):
    kind = "syntax error"


class RankError(LanguageError):
    kind = "rank error"


class LengthError(LanguageError):
    kind = "length error"


class ShapeError(LanguageError):
    kind = "shape error"


class DomainError(LanguageError):
    kind = "domain error"


class IndexRefused(LanguageError):
    kind = "index error"


class ValueUnknown(LanguageError):
    kind = "value error"


class NanError(LanguageError):
    kind = "NaN error"


class NotYet(LanguageError):
    """A part of the language that is known and not provided."""

    kind = "not supported"


class Sandboxed(LanguageError):
    """Files, clock, network and the host stay closed."""

    kind = "sandbox error"


class LimitError(LanguageError):
    kind = "limit error"
