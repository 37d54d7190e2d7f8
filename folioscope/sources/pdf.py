"""Text of PDF files, where a library that reads them is installed."""

from __future__ import annotations

PDF = "application/pdf"


def extracted(data: bytes) -> str | None:
    """The pages' texts with blank lines between; None without a library."""
    try:
        import pymupdf
    except ImportError:
        return None
    with pymupdf.open(stream=data, filetype="pdf") as document:
        pages = [str(page.get_text("text")).strip() for page in document]
    return "\n\n".join(p for p in pages if p)


def as_text(content_type: str, data: bytes) -> tuple[str, str]:
    """(content type, body) of an answer in bytes: a PDF's text as plain text, if it can be read, other bodies decoded."""
    if content_type.split(";")[0].strip().lower() == PDF or data.startswith(b"%PDF-"):
        found = extracted(data)
        return (PDF, "%PDF-") if found is None else ("text/plain", found)
    return content_type, data.decode("utf-8", "replace")
