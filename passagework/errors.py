"""Errors that stop a build or a batch; each carries the offending id."""

from __future__ import annotations


class EngineError(RuntimeError):
    def __init__(self, subject: str, message: str):
        self.subject = subject
        super().__init__(f"{subject}: {message}")


class FetchError(EngineError):
    pass


class ParseError(EngineError):
    pass


class ChunkError(EngineError):
    pass


class VectorIndexError(EngineError):
    pass


class RetrievalError(EngineError):
    pass


class GenerationError(EngineError):
    pass


class EmptyMessageError(ValueError):
    pass


class UnknownDocumentError(ValueError):
    pass
