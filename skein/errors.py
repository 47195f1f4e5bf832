"""Errors with a code, a message and details; rows that fail carry the same text in their `error` column."""

from __future__ import annotations


class SkeinError(Exception):
    code, status = "ERROR", 400

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details

    def to_dict(self) -> dict:
        return {"error_code": self.code, "message": self.message, "details": self.details}


class DocumentProcessingError(SkeinError):
    code = "DOCUMENT_PROCESSING_ERROR"


class UnsupportedFileTypeError(DocumentProcessingError):
    code = "UNSUPPORTED_FILE_TYPE"


class FileSizeExceededError(DocumentProcessingError):
    code = "FILE_SIZE_EXCEEDED"


class EmbeddingError(SkeinError):
    code = "EMBEDDING_ERROR"


class VectorStoreError(SkeinError):
    code = "VECTOR_STORE_ERROR"


class RetrievalError(SkeinError):
    code = "RETRIEVAL_ERROR"


class GenerationError(SkeinError):
    code = "GENERATION_ERROR"


class RateLimitError(GenerationError):
    code, status = "RATE_LIMITED", 429


class NotFoundError(SkeinError):
    code, status = "NOT_FOUND", 404


class ValidationError(SkeinError):
    code, status = "VALIDATION_ERROR", 422
