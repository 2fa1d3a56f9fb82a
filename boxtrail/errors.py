"""What can go wrong, by stage."""

from __future__ import annotations


class DetectionError(Exception):
    """The base of all errors of this package."""


class ModelLoadError(DetectionError):
    pass


class InferenceError(DetectionError):
    pass


class PreprocessingError(DetectionError):
    pass


class PostprocessingError(DetectionError):
    pass


class InvalidDimensions(DetectionError):
    def __init__(self, expected: list[int], actual: list[int]):
        super().__init__(f"expected dimensions {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class UnsupportedFormat(DetectionError):
    pass


class ConfigError(DetectionError):
    pass


class SchemaError(DetectionError):
    pass
