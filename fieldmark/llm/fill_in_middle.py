"""Fill-in-the-middle: texts cut at seeded lines and put together as prefix, suffix, middle.

Where a cut falls is found by a Fenwick tree. A text's UTF-8 bytes are taken in
fixed blocks of ``BLOCK``; the tree stores how many lines end in a block and how
many code points start in it. To find the end of line k the tree is descended by
binary lifting: from the largest power of two down, the next 2^j blocks are
passed over while all their lines come before k, and the code points passed are
added up. What is left is inside one block, whose line ends are looked at there.
So a cut costs the logarithm of the text's blocks, and one more text of any
length needs its bytes, the output and sixteen bytes a block.

The output of ``filled`` is whole text; ``restored`` rebuilds the exact text from
output and form alone, in the engine's own string functions.

Cases: a null text is empty; an empty text, and one that holds a marker, is
``plain``, as is a row that ``rate`` leaves out; a null doc_id is hashed as no
digits; repeated rows have equal outputs; texts may be of any length; further
columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import map_batches

#: Prefix, suffix and middle marker.
MARKERS = "<P>", "<S>", "<M>"
#: Bytes of a block.
BLOCK = 4096


class Fenwick:
    """Line ends and code points of the blocks of a text, as sums over ranges of blocks."""

    def __init__(self, codes: np.ndarray) -> None:
        """``codes``: the text's bytes."""
        self.codes = codes
        starts = np.arange(0, len(codes), BLOCK)
        ends = np.add.reduceat(codes == 10, starts, dtype=np.int64)
        points = np.add.reduceat((codes & 0xC0) != 0x80, starts, dtype=np.int64)
        self.tree = np.zeros((len(starts) + 1, 2), np.int64)
        self.tree[1:] = np.stack([ends, points], axis=1)
        step = 1
        while step <= len(starts):  # nodes whose lowest bit is 2 * step take in the ones half a step before them
            into = np.arange(2 * step, len(starts) + 1, 2 * step)
            self.tree[into] += self.tree[into - step]
            step *= 2

    def end_of(self, line: int) -> tuple[int, int]:
        """Bytes and code points of the text up to and with line ``line`` (from 1); to the text's end where no such line end is."""
        block, ends, points = 0, 0, 0
        for j in range((len(self.tree) - 1).bit_length() - 1, -1, -1):
            step = block + (1 << j)
            if step < len(self.tree) and ends + self.tree[step, 0] < line:
                block, ends, points = step, ends + int(self.tree[step, 0]), points + int(self.tree[step, 1])
        inside = self.codes[block * BLOCK : (block + 1) * BLOCK]
        found = np.flatnonzero(inside == 10)[line - ends - 1 : line - ends]
        cut = int(found[0]) + 1 if len(found) else len(inside)
        return min(block * BLOCK, len(self.codes)) + cut, points + int(np.count_nonzero((inside[:cut] & 0xC0) != 0x80))


def lines_of(text: bytes) -> int:
    """Lines, of which the last may lack its end."""
    return text.count(b"\n") + (text[-1:] not in (b"", b"\n"))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The four numbers that decide a document's cuts and form."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[k : k + 8], 16) for k in range(0, 32, 8)]


def fill(doc_id: int | None, text: bytes, seed: int, rate: int, spm: int, markers: list[bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and output of one text."""
    n, (h1, h2, h3, h4) = lines_of(text), draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in markers):
        return n, "plain", None, None, text
    tree, low, high = Fenwick(np.frombuffer(text, np.uint8)), *sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (z, until) = (tree.end_of(k) if k else (0, 0) for k in (low, high))
    (p, s, m), prefix, middle, suffix = markers, text[:a], text[a:z], text[z:]
    form = "spm" if h4 % 100 < spm else "psm"
    output = b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))
    return n, form, before, until - before, output


def filled(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every row of ``docs``.

    ``rate`` percent of the texts are cut, ``spm`` percent of these with the
    suffix first. A marker's first character must stand nowhere else in the
    markers, so that text and marker together never read as another marker.
    """
    firsts = {m[:1] for m in markers}
    if len(set(markers)) < 3 or "" in firsts or any(c in m[1:] for c in firsts for m in markers) or any(a != b and a.startswith(b) for a in markers for b in markers):
        raise ValueError(f"markers must differ, none may begin another or hold a first character again: {markers}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [m.encode() for m in markers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            done = [fill(d.as_py(), t.as_py(), seed, rate, spm, names) for d, t in zip(batch.column("doc_id"), texts, strict=True)]
            n, form, before, middle, output = zip(*done, strict=True) if done else ([],) * 5
            outputs = pa.array(output, pa.large_binary()).cast(pa.large_string()).cast(batch.column("text").type)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), outputs]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def between(text: Column, after: str, until: str | None) -> Column:
    """What stands between two markers, the second being the text's end if it is None."""
    tail = F.split_part(text, F.lit(after), F.lit(2))
    return F.split_part(tail, F.lit(until), F.lit(1)) if until else tail


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of ``filled`` was made of."""
    p, s, m = markers
    psm = F.concat(between(output, p, s), between(output, m, None), between(output, s, m))
    spm = F.concat(between(output, p, m), between(output, m, None), between(output, s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
