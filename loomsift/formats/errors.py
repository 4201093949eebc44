"""Failures of one file. Wrappers turn them into error rows; they never leave a task."""


class FormatError(Exception):
    """``kind`` is the error class of the result row."""

    kind = "ParseError"


class CleanError(FormatError):
    kind = "CleanError"


class Unsupported(FormatError):
    kind = "UnsupportedFormat"


class TooLarge(FormatError):
    kind = "FileTooLarge"


class ToolMissing(FormatError):
    kind = "ToolNotFound"


def utf8(body: bytes) -> str:
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError as e:
        raise FormatError(f"not UTF-8 at byte {e.start}") from None
