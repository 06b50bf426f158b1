"""Record files as DataFrames of (rec_no, rec)."""

from .records import RecordSource, detect_recfm, divisors, head_note, mismatch_notes, partial_view_note, read_records

__all__ = ["RecordSource", "detect_recfm", "divisors", "head_note", "mismatch_notes", "partial_view_note", "read_records"]
