"""Fill-in-middle transformation of whole texts that lie in compressed frames.

A text is stored as seekable frames (see ``frames``). Its two cuts are found
from the frames' cumulative unit counts, one frame decompressed for each; the
parts are then streamed from the frames, in the order of the output, into the
output's own frames. So a task holds one frame of a text at a time beside the
compressed rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstream.llm import frames
from gridstream.llm.common import give_back, packed, ship, unpacked

SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80  # of texts that are transformed; of those, in the order suffix, prefix, middle
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = [PREFIX, SUFFIX, MIDDLE]


def draws(doc_id: str | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from a document's id; without an id, from an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(framed: dict, doc_id: str | None, seed: int = SEED) -> dict:
    """n, form, prefix_chars, middle_chars (null if plain) and the framed output of one framed text.

    A text that is empty or holds a mark stays plain.
    """
    text = frames.Text(framed)
    h = draws(doc_id, seed)
    n = text.n
    if n == 0 or h[2] % 100 >= FIM_PERCENT or text.find(MARKS):
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": framed}
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = text.place(one), text.place(two)
    parts = {PREFIX: (0, a), SUFFIX: (b, text.bytes), MIDDLE: (a, b)}
    form = "spm" if h[3] % 100 < SPM_PERCENT else "psm"

    def output() -> Iterator[bytes]:
        for mark in [SUFFIX, PREFIX, MIDDLE] if form == "spm" else MARKS:
            yield mark
            yield from text.read(*parts[mark])

    return {"n": n, "form": form, "prefix_chars": a_chars, "middle_chars": b_chars - a_chars, "output": frames.write(output())}


def restore(output: dict, form: str) -> Iterator[bytes]:
    """The text in pieces, from a framed output and its form alone."""
    text = frames.Text(output)
    if form == "plain":
        yield from text.read()
        return
    at = text.find(MARKS)
    first, second = sorted((PREFIX, SUFFIX), key=at.__getitem__)
    ends = {first: at[second], second: at[MIDDLE], MIDDLE: text.bytes}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from text.read(at[mark] + len(mark), ends[mark])


Results = list[tuple[str, str, pa.DataType]]


def _each(df: DataFrame, replaced: list[str], results: Results, row: Callable[..., dict], **own: Column) -> DataFrame:
    """Add the results of ``row``, which gets a row's values of ``own``; columns in
    ``replaced`` and those named like results go, others pass."""
    ship(df.sparkSession)
    names = [n for n, *_ in results]
    rows = packed(df, [*replaced, *names], **own)
    kinds = T.StructType([rows.schema["row"], *[T.StructField(n, T._parse_datatype_string(s)) for n, s, _ in results]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row(*(c[i].as_py() for c in batch.columns[1:])) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in found], a) for n, _, a in results]], ["row", *names])
        give_back()

    return unpacked(rows.mapInArrow(work, kinds), *names)


def framed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Put every whole text into frames: ``frames`` in place of ``text``. A null text
    is an empty one; other columns pass, and an input column ``frames`` is replaced."""
    return _each(docs, [text], [("frames", frames.KIND, frames.ARROW)], lambda t: {"frames": frames.write([t or b""])}, text=F.col(text).cast("binary"))


def infilled(stored: DataFrame, doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Transform framed texts: ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and
    ``output`` (framed) in place of ``frames``.

    The cuts and the form depend on the id alone (a null id counts as an empty
    one), so repeated rows get equal results. Other columns pass; input columns
    named like results are replaced.
    """
    results = [("n", "long", pa.int64()), ("form", "string", pa.string()), ("prefix_chars", "long", pa.int64()), ("middle_chars", "long", pa.int64()), ("output", frames.KIND, frames.ARROW)]
    return _each(stored, ["frames"], results, lambda f, i: transform(f, i, seed), frames=F.col("frames"), id=F.col(doc_id).cast("string"))


def _digests(output: dict, form: str) -> dict:
    whole, again = hashlib.sha256(), hashlib.sha256()
    for piece in frames.Text(output).read():
        whole.update(piece)
    for piece in restore(output, form):
        again.update(piece)
    return {"output_sha256": whole.hexdigest(), "restored_sha256": again.hexdigest()}


def digested(done: DataFrame) -> DataFrame:
    """Replace ``output`` by ``output_sha256`` and ``restored_sha256``, the latter of the
    text that is rebuilt from the output and its form; both are fed frame by frame."""
    results = [(n, "string", pa.string()) for n in ("output_sha256", "restored_sha256")]
    return _each(done, ["output"], results, _digests, output=F.col("output"), form=F.col("form"))


def texts(df: DataFrame, column: str = "output") -> DataFrame:
    """Turn a framed column back into plain text, for those who want it in a row."""
    read = lambda f: {column: b"".join(frames.Text(f).read()).decode()}
    return _each(df, [], [(column, "string", pa.string())], read, framed=F.col(column))
