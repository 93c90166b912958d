"""Whole audits: from traces on disk to verdicts and reports."""
