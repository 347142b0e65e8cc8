"""Errors of the public interface; ``code`` is stable."""

from __future__ import annotations


class EngineError(Exception):
    code = "engine_error"


class CursorError(EngineError):
    """``code`` tells why: checksum, other_request, other_generation, expired or out_of_range."""

    def __init__(self, code: str) -> None:
        super().__init__(f"cursor refused: {code}")
        self.code = code


class ResultTooLarge(EngineError):
    code = "result_too_large"

    def __init__(self, ceiling: int) -> None:
        super().__init__(f"one row alone exceeds {ceiling} characters")


class SymbolNotFound(EngineError):
    code = "symbol_not_found"

    def __init__(self, name: str, suggestions: list[str]) -> None:
        super().__init__(f"no symbol {name!r}")
        self.suggestions = suggestions


class SymbolAmbiguous(EngineError):
    code = "symbol_ambiguous"

    def __init__(self, name: str, candidates: list[str]) -> None:
        super().__init__(f"{name!r} names {len(candidates)} symbols")
        self.candidates = candidates


class NoGeneration(EngineError):
    code = "no_generation"


class CapabilityDowngrade(EngineError):
    code = "capability_downgrade"


class SourceRefused(EngineError):
    """``code`` tells why: missing, bad_span, not_utf8 or hash_mismatch."""

    def __init__(self, code: str) -> None:
        super().__init__(f"source refused: {code}")
        self.code = code


class InvalidRequest(EngineError):
    code = "invalid_request"
