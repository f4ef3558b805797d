"""Errors of the engine, with the fields that a caller needs to react."""

from __future__ import annotations


class TextSearchError(Exception):
    """Base of all errors of this package."""


class IoError(TextSearchError):
    def __init__(self, path: str, cause: str = ""):
        super().__init__(f"cannot read or write {path}" + (f": {cause}" if cause else ""))
        self.path = path


class QueryError(TextSearchError):
    """A query that can't be understood; offset and length are UTF-8 bytes of the query."""

    def __init__(self, offset: int, length: int, message: str):
        super().__init__(f"invalid query at byte {offset}: {message}")
        self.offset, self.length, self.message = offset, length, message


class IndexFormatError(TextSearchError):
    pass


class MalformedRecord(TextSearchError):
    def __init__(self, path: str, line: int, reason: str = ""):
        super().__init__(f"malformed record at {path}:{line}" + (f": {reason}" if reason else ""))
        self.path, self.line, self.reason = path, line, reason
