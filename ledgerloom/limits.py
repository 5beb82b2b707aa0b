"""Document limits. Every operator takes them as a parameter."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # Defaults of the service contract.
    max_upload_mb: int = 15
    max_pdf_pages: int = 20
    max_image_pixels: int = 40_000_000
    max_input_tokens: int = 8192
    min_text_chars: int = 20
    min_digital_chars: int = 40
    max_batch_items: int = 100
    max_concurrent: int = 4
    error_history: int = 100
    error_page: int = 20

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb * 1024 * 1024

    @property
    def max_text_chars(self) -> int:
        """Longest text whose token estimate is still accepted."""
        return self.max_input_tokens * 4

    @property
    def max_page_boxes(self) -> int:
        """Most OCR boxes a page can hold and still pass the token ceiling.

        Every box keeps at least one character and is followed by at least one
        separator, so a page with more boxes always exceeds the ceiling.
        """
        return self.max_text_chars // 2


DEFAULT = Limits()
