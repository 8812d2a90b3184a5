"""Errors that users meet, with what to do about them."""

from __future__ import annotations


class LogweaveError(Exception):
    severity = "error"
    help: str | None = None


class InvalidFormat(LogweaveError):
    help = "give a valid regular expression with named groups"


class UnknownCapture(LogweaveError):
    help = "use only the groups timestamp, thread, method, file, line, body and level"


class MissingCapture(LogweaveError):
    help = "the format needs a group named body"


class NoLogMessages(LogweaveError):
    help = "make sure that the log format matches the log"


class NoLogStatements(LogweaveError):
    help = "make sure that the source paths hold supported source files"


class CannotReadLog(LogweaveError):
    help = "make sure that the log path exists"
