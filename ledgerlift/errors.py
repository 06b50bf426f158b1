"""Errors a caller may want to tell apart."""


class CopybookError(ValueError):
    """The copybook's text can't be read as a record description."""


class LayoutError(ValueError):
    """A record description contradicts itself."""


class LayoutMismatch(Exception):
    """The record length doesn't explain the file; ``notes`` are leads."""

    def __init__(self, file_size: int, record_length: int, remainder: int, notes: list[str]):
        self.file_size, self.record_length, self.remainder, self.notes = file_size, record_length, remainder, notes
        super().__init__("\n  - ".join([f"{file_size} bytes are not whole records of {record_length} bytes: {remainder} are left over", *notes]))


class VariableRecordError(Exception):
    """A record descriptor word that can't be one."""


class CriticalFindings(Exception):
    """Decoding was refused; ``findings`` say why."""

    def __init__(self, findings: list):
        self.findings = findings
        super().__init__("; ".join(f"{f.code} {f.field}" for f in findings))


class PlanError(ValueError):
    """A plan with open decisions was to be rendered."""


class ProposerError(RuntimeError):
    """A proposer is missing or its reply can't be used."""


class VisionError(RuntimeError):
    """A page could not be read."""
