"""Error types. Every expected failure is a ``SuturError`` with a stable ``code``."""

from __future__ import annotations


class SuturError(Exception):
    code = "error"

    def __init__(self, message: str, code: str | None = None) -> None:
        super().__init__(message)
        if code is not None:
            self.code = code


class ManifestError(SuturError):
    code = "manifest_error"


class ValidationError(SuturError):
    code = "dataset_validation_error"


class SplitError(SuturError):
    code = "dataset_split_error"


class VocabularyError(SuturError):
    code = "vocabulary_error"


class ReviewError(SuturError):
    code = "review_overlay_error"


class EvaluationError(SuturError):
    code = "evaluation_error"


class BenchmarkError(SuturError):
    code = "benchmark_error"


class AssemblyError(SuturError):
    code = "assembly_error"


class DocumentError(SuturError):
    code = "document_load_error"


class DecodingError(SuturError):
    code = "decoding_error"


class ConfigurationError(SuturError):
    code = "configuration_error"
