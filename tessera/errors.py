"""What can go wrong, each kind with a name that callers can tell it by."""

from __future__ import annotations


class TesseraError(Exception):
    """``code`` names the kind; services map it to a status of theirs."""

    code = "app_error"


class NotFound(TesseraError, LookupError):
    code = "not_found"


class ValidationFailed(TesseraError, ValueError):
    code = "validation_failed"


class UnsupportedFormat(TesseraError, ValueError):
    code = "unsupported_format"


class FileTooLarge(TesseraError, ValueError):
    code = "file_too_large"


class InvalidJobState(TesseraError, RuntimeError):
    code = "invalid_job_state"


class StorageFailed(TesseraError, OSError):
    code = "storage_error"


class DetectorUnavailable(TesseraError, RuntimeError):
    """A library or model that a detector needs isn't there."""

    code = "detector_unavailable"
