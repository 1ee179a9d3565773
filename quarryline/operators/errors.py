"""Errors by family (inventory 2.21): each carries a code, and says whether trying again may help."""

from __future__ import annotations


class EngineError(Exception):
    code, recoverability = "engine_error", "fatal"


class ConfigurationError(EngineError):
    code = "configuration_error"


class RegistryError(EngineError, KeyError):
    code = "registry_error"

    def __str__(self) -> str:
        return Exception.__str__(self)


class PrerequisiteNotMet(EngineError):
    code = "prerequisite_not_met"


class RepositoryError(EngineError):
    code = "repository_error"


class DocumentError(EngineError):
    """One document's failure; the others go on."""

    code, recoverability = "document_error", "skippable"


class ExtractionError(EngineError):
    code, recoverability = "extraction_error", "skippable"


class ValidationFailed(EngineError):
    code, recoverability = "validation_error", "skippable"


class IncompatibleModel(EngineError):
    code = "incompatible_model"


class BudgetExhausted(EngineError):
    code = "budget_exhausted"


class Retryable(EngineError):
    """Worth another attempt, after `floor` seconds at least."""

    code, recoverability = "provider_unavailable", "retryable"

    def __init__(self, message: str, floor: float = 0.0):
        super().__init__(message)
        self.floor = floor


class RateLimited(Retryable):
    code = "rate_limited"
