"""Errors of the log engine."""


class LogError(Exception):
    """Any error of the engine."""


class LogStateError(LogError):
    """The operation isn't allowed in the log's state."""


class LogClosed(LogStateError):
    pass


class LogDraining(LogStateError):
    pass


class LogNotRunning(LogStateError):
    pass


class BufferFull(LogError):
    pass


class EmptyBatch(LogError):
    pass


class BatchTooLarge(LogError):
    pass


class ChecksumMismatch(LogError):
    pass


class InvalidFrame(LogError):
    pass


class LsnRangeError(LogError, ValueError):
    pass


class CodecRequired(LogError):
    pass


class DecompressError(LogError):
    pass


class CommitConflict(LogError):
    """Another writer committed the same manifest version."""


class CommitError(LogError):
    """A manifest couldn't be written."""


class SegmentNotFound(LogError):
    pass


class ManifestError(LogError):
    pass


class ImportInvalid(LogError):
    pass


class WriterFailed(LogError):
    """Events couldn't be computed, placed or written; nothing is committed."""
