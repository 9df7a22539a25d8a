"""Adapters that need a library or program which may be missing.

Each names what it needs.  ``require`` raises Unavailable before any job
starts if it is not there; nothing is replaced by something lesser.
"""

from __future__ import annotations

import importlib.util
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


class Unavailable(RuntimeError):
    """An engine that an operator needs is not installed."""


@dataclass(frozen=True)
class Engine:
    name: str
    modules: tuple[str, ...] = ()
    programs: tuple[str, ...] = ()

    def missing(self) -> list[str]:
        return [m for m in self.modules if importlib.util.find_spec(m) is None] + [p for p in self.programs if shutil.which(p) is None]

    def require(self) -> None:
        if lost := self.missing():
            raise Unavailable(f"{self.name} needs {', '.join(lost)}")


PDF = Engine("reading PDF", ("pdfplumber",))
PDF_PAGES = Engine("placing PDF pages", ("pypdf", "reportlab"))
WORD = Engine("writing Word files", ("docx",))
IMAGES = Engine("reading images", ("PIL",))
OCR = Engine("recognising text", ("pytesseract", "PIL"), ("tesseract",))
MARKDOWN = Engine("rendering Markdown", ("markdown", "bleach", "tinycss2"))
OFFICE = Engine("converting with an office program", (), ("soffice",))
ENGINES = {e.name: e for e in (PDF, PDF_PAGES, WORD, IMAGES, OCR, MARKDOWN, OFFICE)}


def available() -> dict[str, bool]:
    return {name: not e.missing() for name, e in ENGINES.items()}


def converted(files: DataFrame, engine: Engine, convert: Callable[[bytes, str], bytes]) -> DataFrame:
    """(path, content, error) of files (path, content) that one engine converts, a batch at a time."""
    engine.require()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                try:
                    rows.append((path, convert(bytes(content), path), None))
                except (ValueError, OSError) as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, error string")


def pdf_words(files: DataFrame) -> DataFrame:
    """Positioned words of PDF files, the input of the geometry operators."""
    PDF.require()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        columns = ["path", "page_no", "word_no", "text", "x0", "x1", "top", "bottom", "size", "fontname"]
        for pdf in batches:
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                with pdfplumber.open(io.BytesIO(bytes(content))) as doc:
                    for number, page in enumerate(doc.pages):
                        rows = [(path, number, k, *(w[c] for c in columns[3:])) for k, w in enumerate(page.extract_words(extra_attrs=["size", "fontname"]))]
                        yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")


def rendered_markdown(text: pd.Series) -> pd.Series:
    """Markdown as sanitised HTML."""
    MARKDOWN.require()
    import bleach
    import markdown

    return text.map(lambda t: bleach.clean(markdown.markdown(t or "", extensions=["extra", "tables", "fenced_code"]), tags=set(bleach.ALLOWED_TAGS) | {"p", "pre", "table", "thead", "tbody", "tr", "th", "td", "h1", "h2", "h3", "h4", "hr", "br"}))


def image_sizes(files: DataFrame) -> DataFrame:
    """Width, height and frames of images."""
    IMAGES.require()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from PIL import Image

        for pdf in batches:
            rows = []
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                with Image.open(io.BytesIO(bytes(content))) as img:
                    rows.append((path, img.width, img.height, getattr(img, "n_frames", 1)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "frames"])

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, frames int")


def office_pdf(files: DataFrame, timeout: int = 180) -> DataFrame:
    """Word files as PDF by a headless office program, a private profile each."""

    def convert(content: bytes, path: str) -> bytes:
        import pathlib
        import subprocess
        import tempfile

        with tempfile.TemporaryDirectory() as folder:
            source = pathlib.Path(folder, "in" + pathlib.PurePosixPath(path).suffix)
            source.write_bytes(content)
            done = subprocess.run(["soffice", f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", "pdf", "--outdir", folder, str(source)], timeout=timeout, capture_output=True)
            target = source.with_suffix(".pdf")
            if done.returncode or not target.exists():
                raise ValueError(done.stderr.decode(errors="replace")[:500])
            return target.read_bytes()

    return converted(files, OFFICE, convert)
