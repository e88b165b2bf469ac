"""Token counts by offset-mapped attribution.

Each whole text is encoded once. A byte-level token covers the bytes of its vocabulary string, so the running
sum of these lengths is every token's span; spans are interval-joined with the sections of the text (both
lists are sorted, so the join is a binary search for each token) and counted by section. A token that crosses
a boundary goes to the section that holds most of its bytes, the earlier one when they are equal (RULE
"largest"), or to the section of its first byte ("first"). Every token is counted in exactly one section, so
the sections' counts add up to the text's.

By default sections are lines with their line feeds: the first with a word is the head, those with a bar are
tables, blank ones are blank, the others prose. sections_of may give any (name, start, end) in code points;
what no section covers is counted under the name "".

Defined cases: a null or empty text has no tokens and no sections; sections that overlap are cut at the later
one's start; repeated rows stay; further columns pass through, and new columns get underscores until their
names are free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import bpe
from corpusloom.llm.common import fresh, read_table

RULE = "largest"
SECTION = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("tokens", T.LongType())])
Sections = list[tuple[str, int, int]]


def line_sections(text: str) -> Sections:
    out: Sections = []
    at, headed = 0, False
    for line in _lines(text):
        blank = not line.strip(" \t\n\r\x0b\x0c")
        name = "blank" if blank else "table" if "|" in line else "prose"
        if not blank and not headed:
            name, headed = "head", True
        out.append((name, at, at + len(line)))
        at += len(line)
    return out


def _lines(text: str) -> list[str]:
    """Lines with their line feeds; only a line feed ends a line."""
    parts = text.split("\n")
    lines = [p + "\n" for p in parts[:-1]]
    return lines + [parts[-1]] if parts[-1] else lines


def _byte_bounds(text: str, raw: bytes, sections: Sections) -> tuple[list[str], np.ndarray]:
    """Names and byte starts of consecutive intervals that cover the text, uncovered stretches named ""."""
    names, starts, at = [], [], 0
    cuts = sorted(sections, key=lambda s: (s[1], s[2]))
    for k, (name, lo, hi) in enumerate(cuts):
        hi = min(hi, cuts[k + 1][1]) if k + 1 < len(cuts) else hi
        lo, hi = max(lo, at), min(hi, len(text))
        if lo >= hi:
            continue
        if lo > at:
            names.append("")
            starts.append(at)
        names.append(name)
        starts.append(lo)
        at = hi
    if at < len(text):
        names.append("")
        starts.append(at)
    found = np.array(starts, np.int64)
    if len(raw) != len(text):
        heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        found = heads[found] if len(found) else found
    return names, found


def attribute(text: str, ids: np.ndarray, lengths: np.ndarray, sections: Sections, rule: str = RULE) -> tuple[list[tuple[str, int, int, int]], int]:
    """((name, start, end, tokens) by section, the number of tokens that cross a boundary)."""
    raw = text.encode("utf-8", "replace")
    names, bounds = _byte_bounds(text, raw, sections)
    if not names:
        return [], 0
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    owner = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = np.flatnonzero(owner != last)
    if rule == "largest":
        edges = np.append(bounds, len(raw))
        for t in crossing:
            over = range(owner[t], last[t] + 1)
            owner[t] = max(over, key=lambda s: (min(ends[t], edges[s + 1]) - max(starts[t], edges[s]), -s))
    tokens = np.bincount(owner, minlength=len(names))
    if len(raw) != len(text):
        heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        chars = np.searchsorted(heads, bounds).tolist()
    else:
        chars = bounds.tolist()
    chars.append(len(text))
    return [(n, chars[k], chars[k + 1], int(tokens[k])) for k, n in enumerate(names)], len(crossing)


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, sections_of: Callable[[str], Sections] = line_sections,
                 rule: str = RULE, out_cols: tuple[str, str, str] = ("n_tokens", "n_crossing", "sections")) -> DataFrame:
    """docs with the number of tokens, of those that cross a boundary, and array<struct<name, start, end, tokens>>."""
    path = path or bpe._default_path()
    total, crossing, parts = fresh(docs, *out_cols)
    at = docs.columns.index(text_col)
    more = [T.StructField(total, T.LongType(), False), T.StructField(crossing, T.LongType(), False), T.StructField(parts, T.ArrayType(SECTION), False)]
    schema = T.StructType([*docs.schema.fields, *more])
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.tokenizer(path)
        lengths = np.array([len(s) for s in tokenizer.strings], np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                n, over, found = [], [], []
                for t in batch.column(at):
                    text = t.as_py() or ""
                    ids = tokenizer.encode(text)
                    rows, crossed = attribute(text, ids, lengths, sections_of(text), rule)
                    n.append(len(ids))
                    over.append(crossed)
                    found.append([dict(zip(("name", "start", "end", "tokens"), r)) for r in rows])
                arrays = [pa.array(n, pa.int64()), pa.array(over, pa.int64()), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema.names)

    return docs.mapInArrow(run, schema)


def tokens_in(sections: Column, *names: str) -> Column:
    """Tokens of the sections with one of these names."""
    chosen = F.filter(sections, lambda s: s["name"].isin(*names))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, s: a + s["tokens"])


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = count_tokens(docs).drop("text")
    parts = {f"{name}_tokens": tokens_in(F.col("sections"), name) for name in ("head", "prose", "table", "blank")}
    return found.withColumns(parts).select("doc_id", "n_tokens", "n_crossing", F.size("sections").cast("long").alias("n_sections"), *parts)
