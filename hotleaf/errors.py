"""Errors that carry an SQLSTATE."""

from __future__ import annotations


class DocError(Exception):
    """sqlstate: 22023 argument, 22P02 text form, 23502/23505/23514 constraint, 25006 read-only, 40001 stale,
    42501 permission, 42704/42P07/42710 names, 0A000 unsupported, 55000 state, XX001 corrupt."""

    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"[{sqlstate}] {message}")
        self.sqlstate = sqlstate
        self.detail = message

    def __reduce__(self):
        return DocError, (self.sqlstate, self.detail)
