"""Fill-in-the-middle transformation: texts cut at two token boundaries and put in another order.

Each text is decoded to an array of code points; neighbours of different class (white space or not) mark where a
token ends, the chosen ranks pick two of these ends, and the three pieces are encoded again. All choices (cuts, whether,
which order) follow from a SHA-256 of seed and doc_id, so that any run on any cluster gives the same texts.

Defined cases: a null text counts as empty, and empty texts are plain; texts that hold a sentinel are plain, so that
the form is always restored exactly; a null doc_id is hashed as an empty number; repeated rows have equal results; texts
without white space are one token and still split before or after it; extra columns are kept, and a column with the
name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, returned

SEED = 42
#: Of 100 texts, so many are cut; of 100 cut ones, so many begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def ends_of(codes: np.ndarray) -> np.ndarray:
    """Where the tokens of a text of code points end."""
    blank = (codes == 32) | (codes - np.uint32(9) <= 4)  # what is below 9 wraps around
    inner = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(inner, len(codes)) if len(codes) else inner


def cut(text: str, digest: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, code points of prefix and middle, and the output; digest: hex digits that decide."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ends = ends_of(codes)
    n = len(ends)
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, last))
    prefix, middle, suffix = (piece.tobytes().decode("utf-32-le") for piece in (codes[:a], codes[a:b], codes[b:]))
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    frugal(docs.sparkSession)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    @F.arrow_udf("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    def pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, digests in batches:
            rows = [cut(t or "", d, rate, suffix_first) for t, d in zip(texts.to_pylist(), digests.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)], names=RESULTS)
        returned()

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    found = docs.withColumn("__cut", pieces(F.col("text").cast("string"), digest))
    return found.withColumns({name: F.col(f"__cut.{name}") for name in RESULTS}).drop("__cut")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; each sentinel stands in it once."""
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda k: F.get(piece, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
