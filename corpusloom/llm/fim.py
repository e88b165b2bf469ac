"""Fill-in-middle transformation by a parallel automaton scan.

A text is cut at two line ends into prefix, middle and suffix, which are written in another order behind markers.
An automaton reads the text's bytes: its state says whether a line is open and how much of a marker has been read,
and it counts the lines that begin. What a piece of text does to it is a transition function over all states, with the
lines that begin for each state in which the piece may be entered. Such summaries compose associatively, so
pieces are scanned independently of each other: texts of more than PIECE bytes are dealt out piece by piece, their
summaries are composed in a tree (FAN pieces a block, then the blocks), and each cut is selected downwards: the
block, then the piece in which its line begins, with the state and count at which that piece is entered. The place
inside that piece is looked up where the text is written. A shorter text is one piece, scanned where it is read.
Summaries are kept by the text's hash, so copies share them.

Cuts and form depend on the id and the seed alone: h1 to h4 are 32-bit groups of the sha256 of "seed:id".

Defined cases: a null text is empty; a null id is an empty string in the hash; a text that is empty or holds a
marker stays plain; repeated rows stay and are treated alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, read_table

#: Markers before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
SEED = 7
FIM_PERCENT, SPM_PERCENT = 100, 50
PIECE, FAN = 1 << 16, 128
#: A state is 4 * (a line is open) + (marker bytes read: 0 to 2; 3 for good once a marker has been read).
STATES, SEEN = 8, 3
_TEXT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_PAST = 1 << 62  # no line's number


def step(state: int, byte: int) -> tuple[int, int]:
    """The automaton: (next state, lines that begin with this byte)."""
    open_, read = divmod(state, 4)
    if read != SEEN:
        char = bytes([byte])
        read = SEEN if read == 2 and char == b">" else 2 if read == 1 and char in b"PSM" else 1 if char == b"<" else 0
    return 4 * (byte != 10) + read, 1 - open_


def summary(piece: bytes) -> tuple[list[int], list[int]]:
    """What step does over a whole piece: the next state and the lines that begin, for each state of entry."""
    if not piece:
        return list(range(STATES)), [0] * STATES
    ends = piece.endswith(b"\n")
    begun = piece.count(b"\n") + (not ends)
    inside = any(m in piece for m in MARKERS)
    starts = {m[1:] for m in MARKERS}
    after = [inside, inside or piece[:2] in starts, inside or piece[:1] == b">", True]  # by bytes read before
    tail = 1 if piece.endswith(b"<") else 2 if piece[-2:] in {m[:2] for m in MARKERS} else 0
    half = 2 if piece in (b"P", b"S", b"M") else tail  # one byte that carries on after "<"
    nexts = [4 * (not ends) + (SEEN if after[r] else half if r == 1 else tail) for r in range(4)]
    return nexts * 2, [begun] * 4 + [begun - 1] * 4


def line_start(piece: bytes, state: int, rank: int) -> int:
    """Where the line of this rank begins in a piece that is entered in this state."""
    if state < 4:
        if rank == 0:
            return 0
        rank -= 1
    return int(np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)[rank]) + 1


def _chars(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def write(raw: bytes, form: str, a: int, b: int) -> bytes:
    """The output for cuts at bytes a and b."""
    if form == "psm":
        return b"".join((PREFIX, raw[:a], SUFFIX, raw[b:], MIDDLE, raw[a:b]))
    if form == "spm":
        return b"".join((SUFFIX, raw[b:], PREFIX, raw[:a], MIDDLE, raw[a:b]))
    return raw


def read(output: bytes, form: str) -> bytes:
    """The text that write got. A marker's first byte occurs in it once, so the first match is the marker."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _drawn(seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _form(fim_percent: int, spm_percent: int) -> Column:
    spm = F.when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    return F.when(F.col("h3") % 100 >= fim_percent, "plain").otherwise(spm)


def _built(raws: list[bytes], ids: pa.Array, ns: list[int], forms: list[str], cuts: list[tuple[int, int]]) -> pa.RecordBatch:
    outputs, before, middle = [], [], []
    for raw, form, (a, b) in zip(raws, forms, cuts):
        outputs.append(write(raw, form, a, b))
        before.append(None if form == "plain" else _chars(raw[:a]))
        middle.append(None if form == "plain" else _chars(raw[a:b]))
    arrays = [ids, pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64())]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(outputs, pa.binary()).cast(pa.string())], [f.split()[0] for f in _TEXT.split(", ")])


def _raws(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, h1, h2, form): texts of one piece."""
    for batch in batches:
        raws = _raws(batch.column(1))
        ns, forms, cuts = [], [], []
        for raw, h1, h2, form in zip(raws, *(batch.column(k).to_pylist() for k in (2, 3, 4))):
            nexts, begun = summary(raw)
            n = begun[0]
            marked = not raw or nexts[0] % 4 == SEEN
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            ns.append(n)
            forms.append("plain" if marked else form)
            cuts.append((0, 0) if marked else tuple(len(raw) if k == n else line_start(raw, 0, k) for k in (low, high)))
        yield _built(raws, batch.column(0), ns, forms, cuts)


def _pieces(size: int):
    """(doc_id, key, text) -> a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(2).cast(pa.binary())):
                view = raw.as_buffer()
                count = -(-view.size // size)
                for at in range(0, count, 64):
                    some = range(at, min(at + 64, count))
                    parts = pa.array([view.slice(p * size, min(size, view.size - p * size)).to_pybytes() for p in some], pa.binary())
                    same = pa.array([k] * len(some), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(some, pa.int32()), parts], ["doc_id", "key", "piece", "part"])

    return run


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, piece, part) -> (key, piece, next, begun)."""
    for batch in batches:
        found = [summary(p.as_py()) for p in batch.column(2)]
        nexts, begun = pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nexts, begun], ["key", "piece", "next", "begun"])


def _located(size: int):
    """(doc_id, text, n, form, at1, at2): texts of several pieces, each cut given as (piece, state, rank), null for the end."""

    def place(raw: bytes, at: dict | None) -> int:
        if at is None:
            return len(raw)
        begin = at["piece"] * size
        return begin + line_start(raw[begin : begin + size], at["state"], at["rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = _raws(batch.column(1))
            places = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            cuts = [(place(raw, one), place(raw, two)) for raw, (one, two) in zip(raws, places)]
            yield _built(raws, batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist(), cuts)

    return run


def _composed(parts: str) -> str:
    """SQL: the summary of consecutive parts, a sorted array of (place, next, begun)."""
    same = f"transform(sequence(0, {STATES - 1}), s -> struct(s as next, 0L as begun))"
    then = "transform(acc, a -> struct(x.next[a.next] as next, a.begun + x.begun[a.next] as begun))"
    return f"aggregate({parts}, {same}, (acc, x) -> {then})"


def _selected(parts: str, line: str, state: str) -> str:
    """SQL: (place, state, rank): the part in which this line begins, counted from the parts' start, entered in this state; null past the last."""
    start = f"named_struct('state', {state}, 'left', {line}, 'at', named_struct('place', -1, 'state', -1, 'rank', -1L))"
    here = "acc.at.place < 0 and acc.left < x.begun[acc.state]"
    at = f"if({here}, named_struct('place', x.place, 'state', acc.state, 'rank', acc.left), acc.at)"
    then = f"named_struct('state', x.next[acc.state], 'left', acc.left - x.begun[acc.state], 'at', {at})"
    return f"aggregate({parts}, {start}, (acc, x) -> {then}, acc -> if(acc.at.place < 0, null, acc.at))"


def _ordered(place: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "next", "begun")))


def _cut_large(large: DataFrame, form: Column, piece: int, fan: int) -> DataFrame:
    """(doc_id, text, h1 to h4, key): texts of several pieces."""
    pieces = large.select("doc_id", "key", "text").mapInArrow(_pieces(piece), "doc_id long, key string, piece int, part binary")
    dealt = pieces.repartition(F.xxhash64("doc_id", "key", "piece")).select("key", "piece", "part")
    scanned = dealt.mapInArrow(_summaries, "key string, piece int, next array<int>, begun array<long>")
    scanned = scanned.groupBy("key", "piece").agg(F.first("next").alias("next"), F.first("begun").alias("begun"))
    blocks = scanned.withColumn("block", F.expr(f"piece div {fan}").cast("int")).groupBy("key", "block").agg(_ordered("piece").alias("parts"))
    blocks = materialize(blocks.withColumn("all", F.expr(_composed("parts"))), "fim-blocks")
    inner = blocks.select("key", "block", F.col("all.next").alias("next"), F.col("all.begun").alias("begun"))
    texts = inner.groupBy("key").agg(_ordered("block").alias("blocks")).withColumn("all", F.expr(_composed("blocks"))[0])
    texts = texts.select("key", "blocks", F.col("all.begun").alias("n"), (F.col("all.next") % 4 == SEEN).alias("marked"))
    ids = large.select("key", "doc_id", "h1", "h2", form.alias("form")).distinct().join(texts, "key")
    low, high = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    ids = ids.withColumn("form", F.when(F.col("marked"), "plain").otherwise(F.col("form")))
    lines = F.posexplode(F.array(F.least(low, high), F.greatest(low, high))).alias("cut", "line")
    cuts = ids.select("key", "doc_id", "n", "form", "blocks", lines)
    cuts = cuts.withColumn("in", F.expr(_selected("blocks", "line", "0"))).drop("blocks", "line")
    inside = blocks.select(F.col("key").alias("k"), F.col("block").alias("b"), "parts")
    cuts = cuts.join(inside, (F.col("key") == F.col("k")) & (F.col("in.place") == F.col("b")), "left")
    place = F.expr(_selected("parts", "`in`.rank", "`in`.state"))
    cuts = cuts.select("key", "doc_id", "n", "form", "cut", place.alias("p"))
    at = [F.max(F.when(F.col("cut") == c, F.expr("if(p is null, null, named_struct('piece', p.place, 'state', p.state, 'rank', p.rank))"))).alias(f"at{c + 1}") for c in (0, 1)]
    found = materialize(cuts.groupBy("key", "doc_id", "n", "form").agg(*at), "fim-cuts").withColumnsRenamed({"doc_id": "id", "key": "k"})
    rows = large.select("doc_id", "key", "text").join(found, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return rows.select("doc_id", "text", "n", "form", "at1", "at2").mapInArrow(_located(piece), _TEXT)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each of docs; n is the number of lines."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.select("doc_id", "text", *_drawn(seed))
    form = _form(fim_percent, spm_percent)
    short = F.octet_length("text") <= piece
    small = source.filter(short).select("doc_id", "text", "h1", "h2", form.alias("form")).mapInArrow(_whole, _TEXT)
    return small.union(_cut_large(source.filter(~short).withColumn("key", F.sha2("text", 256)), form, piece, fan))


def restore(cut: DataFrame) -> DataFrame:
    """Rows of transform with the text rebuilt from output and form, as column restored."""
    names = cut.columns
    at, how = names.index("output"), names.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read(raw, form) for raw, form in zip(_raws(batch.column(at)), batch.column(how).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "restored"])

    return cut.mapInArrow(run, f"{_TEXT}, restored string")


def query(spark, sf_dir: str) -> DataFrame:
    found = restore(transform(read_table(spark, sf_dir, "documents")))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


#: The same rows in DuckDB's SQL.
SQL = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') us, ('0x' || substr(h, 1, 8))::bigint h1, ('0x' || substr(h, 9, 8))::bigint h2,
  ('0x' || substr(h, 17, 8))::bigint h3, ('0x' || substr(h, 25, 8))::bigint h4 from d),
c as (select *, len(us)::bigint n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from u),
p as (select *, array_to_string(us[1:a], '') pre, array_to_string(us[a + 1:b], '') mid, array_to_string(us[b + 1:n], '') suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end prefix_chars, case when form <> 'plain' then length(mid)::bigint end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256,
  sha256(case form when 'plain' then t else pre || mid || suf end) restored_sha256 from p
"""
