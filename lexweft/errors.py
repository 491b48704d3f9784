"""Errors raised on the driver."""


class AlignmentError(Exception):
    """Base of this package's errors."""


class InvalidConfig(AlignmentError):
    """A setting or an input folder isn't usable."""


class MalformedDocument(AlignmentError):
    """An input file isn't an array of the expected objects."""


class NoReferenceDocuments(AlignmentError):
    """There is nothing to align with."""


class NoQueryDocuments(AlignmentError):
    """There is nothing to align."""


class ConcurrentWrite(AlignmentError):
    """Other writers kept committing first."""
