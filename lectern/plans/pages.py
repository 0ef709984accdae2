"""Pages of documents as images, by whichever renderer is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_PAGES, SMALLEST, LARGEST, USUAL = 10, 64, 4096, 1024


class Renderer(Protocol):
    def sizes(self, content: bytes) -> list[tuple[float, float]]:
        """Width and height of each page."""

    def png(self, content: bytes, page: int, scale: float) -> bytes: ...


def wanted(start_page: int = 1, end_page: int | None = None, size: int = USUAL, mime_type: str | None = None) -> tuple[range, int]:
    """Page numbers (from 1) and the size in pixels, or ValueError."""
    last = start_page if end_page is None else end_page
    if mime_type and mime_type != "application/pdf":
        raise ValueError(f"no previews of {mime_type}")
    if min(start_page, last) < 1:
        raise ValueError("pages are counted from 1")
    if start_page > last:
        raise ValueError("the first page is after the last")
    if last - start_page >= MOST_PAGES:
        raise ValueError(f"more than {MOST_PAGES} pages")
    return range(start_page, last + 1), min(LARGEST, max(SMALLEST, int(size)))


def scale_to(size: int, width: float, height: float) -> float:
    """What the longer side has to be multiplied by."""
    return max(0.01, size / max(1.0, width, height))


def previews(files: DataFrame, make: Callable[[], Renderer], start_page: int = 1, end_page: int | None = None, size: int = USUAL) -> DataFrame:
    """path, page, png, error_message of binary files (path, content); a file with fewer pages, or that cannot be read, gives its error."""
    pages, pixels = wanted(start_page, end_page, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer = make()
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    sizes = renderer.sizes(content)
                    if pages[-1] > len(sizes):
                        raise ValueError(f"page {pages[-1]} of {len(sizes)}")
                    rows += [(path, p, renderer.png(content, p, scale_to(pixels, *sizes[p - 1])), None) for p in pages]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "page", "png", "error_message"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, png binary, error_message string")
