"""Token counts of fields and sections by offsets: each document is encoded once, as a whole.

Every token has a character span.  A section is a character span too, so the
tokens of a section come from an interval join of the two ordered lists, done
row by row with binary searches.  Nothing is encoded twice, and the counts of
a document's sections together are the count of the document.

A token may cross a border: it then has characters in several sections (or
only begins in one).  ``rule`` says whose it is:

* ``"start"``: the section that holds its first character;
* ``"most"``: the section with most of its characters, the first one on a tie;
* ``"share"``: every section, by its share of the token's characters.

A token of which no character lies in a section counts as outside (section
null).  A character of several bytes may be split between tokens: the token
that begins it has it whole, and a token that has no character of its own
belongs to the character its bytes are in.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import arrow_schema, row_batches
from labtrail.llm.packing import vocabulary

COUNTS = (
    "doc_id long, section long, name string, start long, end long, tokens double, crossing long, doc_tokens long"
)
RULES = ("start", "most", "share")


@cache
def _encoding(path: str, pattern: str):
    """The encoding and the length in bytes of each of its tokens; one per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token, and the one after its last."""
    encoding, sizes = _encoding(path, pattern)
    ids = encoding.encode_to_numpy(text)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if len(ends) and ends[-1] != len(text):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        leads = (raw & 0xC0) != 0x80
        # characters begun before each byte; a token in the middle of a character lies in that one
        begun = np.concatenate([[0], np.cumsum(leads)])
        lead = leads[starts]
        ends = begun[ends]
        starts = np.where(lead, begun[starts], begun[starts] - 1)
        ends = np.maximum(ends, starts + 1)
    return starts, ends


def attribute(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and border-crossing tokens of each section [begins, stops), which are ordered and don't overlap.

    An interval join by binary search: a token meets the sections from the
    first that ends after its start to the last that begins before its end.
    """
    n = len(begins)
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not len(starts):
        return counts, crossing
    first = np.searchsorted(stops, starts, "right")
    last = np.searchsorted(begins, ends, "left") - 1
    hit = first <= last
    inside = hit & (first == last) & (begins[np.minimum(first, n - 1)] <= starts) & (ends <= stops[np.minimum(first, n - 1)])
    counts += np.bincount(first[inside], minlength=n)
    for t in np.flatnonzero(hit & ~inside):
        sections = np.arange(first[t], last[t] + 1)
        shares = np.minimum(stops[sections], ends[t]) - np.maximum(begins[sections], starts[t])
        sections, shares = sections[shares > 0], shares[shares > 0]
        if not len(sections):
            continue
        crossing[sections] += 1
        if rule == "share":
            counts[sections] += shares / (ends[t] - starts[t])
        elif rule == "most":
            counts[sections[np.argmax(shares)]] += 1
        elif begins[sections[0]] <= starts[t]:
            counts[sections[0]] += 1
    return counts, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections of a plain text: its lines, each with its line break."""
    begins = [0]
    at = text.find("\n")
    while at >= 0 and at + 1 < len(text):
        begins.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(begins, np.int64), np.array([*begins[1:], len(text)], np.int64)


def given_sections(text: str, spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Begins, ends and names of given spans, by place and cut to the text."""
    whole = [s for s in spans or [] if s and s["start"] is not None and s["end"] is not None]
    cut = sorted((min(max(0, s["start"]), len(text)), min(len(text), s["end"]), s["name"] or "") for s in whole)
    begins = np.array([b for b, _, _ in cut], np.int64)
    return begins, np.maximum(begins, np.array([e for _, e, _ in cut], np.int64)), [name for _, _, name in cut]


def count_tokens(
    docs: DataFrame,
    sections: str | None = None,
    rule: str = "most",
    vocab: str = "byte_bpe_50k.tiktoken",
    pattern: str | None = None,
) -> DataFrame:
    """One row per section of each document, numbered from 0 by place, and one (section null) for tokens outside all.

    ``docs`` needs ``doc_id`` and ``text``.  ``sections`` names a column
    ``array<struct<name:string,start:long,end:long>>`` of character spans that
    don't overlap; without it the sections are the text's lines.  Spans beyond
    the text are cut to it; empty or null spans have no tokens, and overlapping
    ones are an error.  A null or empty text has one empty section if sections
    are lines, and no tokens.  Rows with a null or repeated doc_id are counted
    each for itself; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    import public_tokenizers

    path, pattern = vocabulary(vocab), pattern or public_tokenizers.PATTERN
    out = arrow_schema(COUNTS)
    given = sections is not None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, 256):
            spans = batch.column(2).to_pylist() if given else [None] * batch.num_rows
            parts, names, rows, totals = [], [], [], []
            for text, own in zip(batch.column(1).to_pylist(), spans):
                text = text or ""
                if given:
                    b, e, called = given_sections(text, own)
                else:
                    b, e = line_sections(text)
                    called = []
                full = e > b
                if np.any(b[full][1:] < e[full][:-1]):
                    raise ValueError("sections of a document overlap")
                starts, ends = token_spans(text, path, pattern)
                counts, crossing = np.zeros(len(b)), np.zeros(len(b), np.int64)
                counts[full], crossing[full] = attribute(starts, ends, b[full], e[full], rule)
                number = np.arange(len(b))
                if given:
                    rest = round(len(starts) - counts.sum(), 9)
                    number, b, e = np.append(number, -1), np.append(b, 0), np.append(e, len(text))
                    counts, crossing = np.append(counts, rest), np.append(crossing, 0)
                    called.append("outside")
                parts.append((number, b, e, counts, crossing))
                names += called
                rows.append(len(b))
                totals.append(len(starts))
            number, b, e, counts, crossing = (np.concatenate(c) for c in zip(*parts))
            owner = np.repeat(np.arange(batch.num_rows), rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner)), pa.array(number, mask=number < 0), pa.array(names if given else ["line"] * len(b), pa.string()),
                pa.array(b), pa.array(e), pa.array(counts), pa.array(crossing), pa.array(np.array(totals)[owner]),
            ], schema=out)

    columns = ["doc_id", "text"] + ([sections] if given else [])
    rows = docs.select(*columns)
    if given:
        rows = rows.withColumn(sections, F.col(sections).cast("array<struct<name:string,start:long,end:long>>"))
    return rows.mapInArrow(count, COUNTS)
