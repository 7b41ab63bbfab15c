"""The one exception type of the engine: a code, a message, a hint and details."""

from __future__ import annotations


class EngineError(ValueError):
    """Raised for every user error; ``code`` is stable, ``message`` is for people."""

    def __init__(self, code: str, message: str, hint: str | None = None, **details):
        super().__init__(f"{code}: {message}" + (f" ({hint})" if hint else ""))
        self.code, self.message, self.hint, self.details = code, message, hint, details

    def envelope(self) -> dict:
        """The failure as a JSON-ready mapping."""
        out = {"ok": False, "error": {"code": self.code, "message": self.message, **self.details}}
        if self.hint:
            out["hint"] = self.hint
        return out


def ok(data, hint: str | None = None) -> dict:
    """A success as a JSON-ready mapping."""
    return {"ok": True, "data": data} | ({"hint": hint} if hint else {})
