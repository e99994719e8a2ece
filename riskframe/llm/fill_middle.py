"""Fill-in-the-middle: cut texts in three and exchange the parts by in-place block rotation.

A text is cut between tokens (leading blanks belong to a word; blanks at the end are a token of
their own) at two places drawn from the hash of its id. The sentinels are inserted into a bytearray
of the text, ``<P>prefix<M>middle<S>suffix``, and one rotation moves the suffix to its place: before
the middle (psm) or before everything (spm). A rotation is three reversals and needs no second text.
``restore`` finds the sentinels, rotates back and takes them out; it reads nothing but the output and its form.

Empty and null texts, and texts that hold a sentinel, stay as they are (form ``plain``; a null text
becomes an empty output). A null id is hashed as the text ``null``. Rows are handled one by one: repeated
rows give equal results, an empty table none. All columns are kept; the result is one struct column, and a
column of its name is replaced. Very long texts are held once as bytes and once as result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, RATE, SPM_SHARE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RESULT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"
#: Bytes exchanged at once in a reversal.
SWAP = 1 << 16


def reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverse a stretch in place."""
    while end - start > 1:
        step = min(SWAP, (end - start) // 2)
        head = buffer[start : start + step].copy()
        buffer[start : start + step] = buffer[end - step : end][::-1]
        buffer[end - step : end] = head[::-1]
        start, end = start + step, end - step


def rotate(buffer: np.ndarray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks [start, middle) and [middle, end) in place."""
    reverse(buffer, start, middle)
    reverse(buffer, middle, end)
    reverse(buffer, start, end)


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Places in the bytes after each token: where a word ends, and the end of blanks at the end of the text."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, raw.size) if raw.size and blank[-1] else ends


def characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def arrange(text: bytes, draws: tuple[int, int], plain: bool, spm: bool) -> tuple:
    """n, form, characters of prefix and middle, output."""
    raw = np.frombuffer(text, np.uint8)
    places = np.concatenate(([0], token_ends(raw)))
    n = places.size - 1
    if plain or not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted(int(places[d % (n + 1)]) for d in draws)
    counts = characters(raw[:a]), characters(raw[a:b])
    out = bytearray(text)
    out[b:b], out[a:a], out[0:0] = SUFFIX, MIDDLE, PREFIX
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    rotate(np.frombuffer(out, np.uint8), 0 if spm else middle, suffix, len(out))
    return n, "spm" if spm else "psm", *counts, bytes(out)


def rearrange_back(output: bytes, form: str) -> bytes:
    """The text from an output and its form."""
    if form == "plain":
        return output
    out = bytearray(output)
    view = np.frombuffer(out, np.uint8)
    if form == "spm":  # suffix, prefix, middle
        rotate(view, 0, output.index(PREFIX), len(out))
    else:  # prefix, suffix, middle
        rotate(view, output.index(SUFFIX), output.index(MIDDLE), len(out))
    del view
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(mark)
        del out[at : at + len(mark)]
    return bytes(out)


def _bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def _text(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _arrange(text: pa.Array, first: pa.Array, second: pa.Array, plain: pa.Array, spm: pa.Array) -> pa.Array:
    rows = zip(_bytes(text), first.to_pylist(), second.to_pylist(), plain.to_pylist(), spm.to_pylist())
    n, form, prefix, middle, output = zip(*[arrange(t or b"", (a, b), p, s) for t, a, b, p, s in rows]) if len(text) else [[]] * 5
    whole = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _text(list(output))]
    return pa.StructArray.from_arrays(whole, names=["n", "form", "prefix_chars", "middle_chars", "output"])


def _restore(output: pa.Array, form: pa.Array) -> pa.Array:
    return _text([None if o is None else rearrange_back(o, f) for o, f in zip(_bytes(output), form.to_pylist())])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
                   spm_share: int = SPM_SHARE, column: str = "__fim") -> DataFrame:
    """``docs`` with a struct column: n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, output.

    ``rate`` of 100 texts are rearranged, ``spm_share`` of 100 of these as suffix, prefix, middle.
    """
    token = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256)
    h = [F.conv(F.substring(token, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    found = F.arrow_udf(_arrange, RESULT)(F.col(text), h[0], h[1], h[2] % 100 >= rate, h[3] % 100 < spm_share)
    return docs.withColumn(column, found)


def restore(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made of."""
    return F.arrow_udf(_restore, "string")(output, form)
