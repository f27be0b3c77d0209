"""Documents to chunks: blocks packed up to a token budget under their section, oversized blocks cut by sentences and
long sentences by windows with overlap. A document is one unit of work; documents run side by side."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import scalars
from pagewright.operators.markdown import parse_blocks

MAX_TOKENS, OVERLAP = 512, 64
#: Strings after which a window may be cut (fixed values).
BREAKS = ("\n\n", "。", "．", ".", "!", "?", "！", "？", "\n", " ")
_CJK = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in scalars.CJK_RANGES) + "]")
_PARAGRAPH = re.compile(r"\n\s*\n")
_END = re.compile(r"[。．]|[.!?]+(?=\s|$)|(?:(?<=[。．])|^)[.!?]+(?=[。．])")


def count_tokens(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return cjk + -(-(len(text) - cjk) // 4)


def check_budget(max_tokens: int, overlap: int) -> None:
    if max_tokens <= 0 or overlap < 0 or overlap >= max_tokens:
        raise ValueError("max_tokens must be positive and overlap at least 0 and below it")


def sentences(text: str) -> list[str]:
    found = []
    for paragraph in _PARAGRAPH.split(text):
        paragraph, at = paragraph.strip(), 0
        for m in _END.finditer(paragraph):
            found.append(paragraph[at : m.end()])
            at = m.end()
        found.append(paragraph[at:])
    return [s for s in found if s.strip()]


class _Cost:
    """Token counts of any span of a text in constant time."""

    def __init__(self, text: str):
        self.cjk = [0]
        for c in text:
            self.cjk.append(self.cjk[-1] + bool(_CJK.match(c)))

    def __call__(self, a: int, b: int) -> int:
        cjk = self.cjk[b] - self.cjk[a]
        return cjk + -(-(b - a - cjk) // 4)

    def furthest(self, start: int, budget: int) -> int:
        """The largest end with at most ``budget`` tokens from start, by halving; one character at least."""
        lo, hi = start, min(len(self.cjk) - 1, start + 4 * budget)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self(start, mid) <= budget else (lo, mid - 1)
        return max(lo, min(start + 1, len(self.cjk) - 1))

    def back(self, end: int, budget: int) -> int:
        """The smallest start with at most ``budget`` tokens up to end."""
        lo, hi = max(0, end - 4 * budget), end
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self(mid, end) <= budget else (mid + 1, hi)
        return lo


def split_windows(text: str, max_tokens: int, overlap: int) -> list[str]:
    """Windows of at most the budget, cut after the last break in their second half, else where the budget ends; each
    goes back by the overlap."""
    cost, found, start = _Cost(text), [], 0
    while start < len(text):
        end = cost.furthest(start, max_tokens)
        if end < len(text):
            window = text[start:end]
            cuts = [at + len(b) for b in BREAKS if (at := window.rfind(b)) >= len(window) // 2]
            end = start + max(cuts, default=len(window))
        found.append(text[start:end])
        if end >= len(text):
            break
        start = max(cost.back(end, overlap), start + 1)
    return found


def split_oversized(text: str, max_tokens: int, overlap: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Sentences packed up to the budget and joined as they are; a sentence over the budget is cut into windows."""
    found, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        found.append("".join(held).strip())
        held, size = [], 0

    for sentence in sentences(text):
        n = count(sentence)
        if n > max_tokens:
            flush()
            found += split_windows(sentence, max_tokens, overlap)
            continue
        if held and size + n > max_tokens:
            flush()
        held.append(sentence)
        size += n
    flush()
    return [x for x in found if x.strip()]


def chunk_markdown(markdown: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, count: Callable[[str], int] = count_tokens, parse=parse_blocks) -> list[tuple[str, str | None, int | None]]:
    """(text, section, page) of a document's chunks.

    Level-1 headings are left out and change nothing. Other headings end a chunk and name the section. A page marker
    sets the page from there on, also of text not yet emitted. Rules end a chunk. A block over the budget ends a chunk
    and is cut by itself; others are added while the sum of their own counts stays within the budget.
    """
    check_budget(max_tokens, overlap)
    found: list[tuple[str, str | None, int | None]] = []
    held: list[str] = []
    size, section, page = 0, None, None

    def flush() -> None:
        nonlocal held, size
        if text := "\n\n".join(held).strip():
            found.append((text, section, page))
        held, size = [], 0

    for block in parse(markdown):
        if block.kind == "heading":
            if block.level > 1:
                flush()
                section = block.heading
        elif block.kind == "page_marker":
            page = block.page
        elif block.kind == "hr":
            flush()
        elif block.source.strip():
            n = count(block.source)
            if n > max_tokens:
                flush()
                found += [(x, section, page) for x in split_oversized(block.source, max_tokens, overlap, count)]
                continue
            if held and size + n > max_tokens:
                flush()
            held.append(block.source)
            size += n
            if size >= max_tokens:
                flush()
    flush()
    return found


SLICE_ROWS = 256
CHUNK_SCHEMA = "document_id string, title string, chunk_index int, text string, section string, page int"


def chunk_documents(documents: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, chunker: Callable | None = None, keep_errors: bool = False) -> DataFrame:
    """Chunks of rows of document_id, title, markdown, with ids, token counts and checksums.

    ``chunker``: another function of (markdown, max_tokens, overlap) that gives (text, section, page) triples. With
    ``keep_errors`` a document that it fails on gives one row of null chunk_index with the message in ``error``, and does
    not end the job.
    """
    check_budget(max_tokens, overlap)
    cut = chunker or chunk_markdown
    schema = pa.schema([("document_id", pa.string()), ("title", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("section", pa.string()), ("page", pa.int32()), ("error", pa.string())])

    def chunks(document: str, title: str, markdown: str | None) -> list[tuple]:
        try:
            return [(document, title, i, *chunk, None) for i, chunk in enumerate(cut(markdown or "", max_tokens, overlap), 1)]
        except Exception as problem:  # noqa: BLE001
            if not keep_errors:
                raise
            return [(document, title, None, None, None, None, str(problem) or type(problem).__name__)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = [x for row in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True) for x in chunks(*row)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    source = documents.select(F.col("document_id").cast("string").alias("document_id"), F.col("title").cast("string").alias("title"), F.col("markdown"))
    made = source.mapInArrow(run, CHUNK_SCHEMA + ", error string")
    if not keep_errors:
        made = made.drop("error")
    return made.withColumns({"chunk_id": scalars.stable_chunk_id(F.col("document_id"), F.col("chunk_index")), "token_count": scalars.token_count(F.col("text")), "checksum": scalars.text_checksum(F.col("text"))})


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Metadata rows without text, with the ids of both search tables."""
    return chunks.drop("text").withColumns({"vector_point_id": scalars.point_id(F.col("chunk_id")), "keyword_document_id": F.col("chunk_id")})


def index_payload(chunks: DataFrame) -> DataFrame:
    """The vector payload and the keyword document of each chunk."""
    fields = {"docId": "document_id", "chunkId": "chunk_id", "chunkIndex": "chunk_index", "title": "title", "section": "section", "page": "page", "text": "text", "checksum": "checksum"}
    payload = F.struct(*[F.col(c).alias(k) for k, c in fields.items()])
    return chunks.select("chunk_id", scalars.point_id(F.col("chunk_id")).alias("point_id"), payload.alias("payload"), F.struct(F.col("chunk_id").alias("_id"), payload.alias("document")).alias("keyword"))


