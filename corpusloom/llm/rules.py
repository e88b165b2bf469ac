"""Quality rules: counts inside each text and cross-document line frequency.

Base counts are taken from each whole text where it is read. Cross-document rule: a line is normalised (ASCII
lower case, digits as 0, runs of white space as one space), and for each host the documents that hold it are counted.
Copies of a document are one document: exact ones by the hash of their text, near ones by the contexts of the line,
which are the least and the greatest hash among the text's other lines (a text of that line alone has the empty
context); the mean of both numbers of distinct contexts counts. A document copied a thousand times, with a word changed
here or there, so isn't its own boilerplate, while a line in a thousand documents that differ elsewhere has hundreds of
contexts. Where they are fewer than min_free of a line's texts, the texts are near copies (about 8 of 9 lines alike)
and the line stays. That depends on hashes: a group of near copies whose least or greatest hash lies far inside the
range may lose a line (in the test one of twelve), and a header of many lines above little text may stay.
Lines of more contexts than max(min_docs, per_decade * log10(texts of the host)) are removed: the limit grows from
45 at a thousand texts to 90 at a million, so a line in a small part of a hot host's documents goes as well. A document
whose other lines keep fewer than min_words words, or less than min_kept of its words, is rejected.

Only 64-bit hashes of lines are shuffled: counts of (host, line) as partial sums, then (host, line, context) of lines
in more than min_docs texts, which spreads a hot line over its contexts. What a text loses comes back as one sum.

Defined cases: a null text counts as empty and fails the base rules (fewer than 20 words); a null host is a
host of its own; blank lines are no lines; repeated rows are judged each by itself and alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, read_table, release

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
MIN_DOCS = 20
PER_DECADE = 15
MIN_FREE = 0.25
MIN_KEPT = 0.3
_MIX = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, np.uint64) | np.uint64(1)
_NORMAL = bytes.maketrans(bytes(range(65, 91)) + b"123456789", bytes(range(97, 123)) + b"0" * 9)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of width words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    keys = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        ids ^= ids >> np.uint64(29)
        for k in range(width):
            keys += ids[k : k + n] * _MIX[k]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, _SPACES))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _line_hashes(raw: bytes) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line with a word."""
    hashes, counts = [], []
    for line in raw.translate(_NORMAL).split(b"\n"):
        words = line.split()
        if words:
            hashes.append(int.from_bytes(hashlib.md5(b" ".join(words), usedforsecurity=False).digest()[:8]) - (1 << 63))
            counts.append(len(words))
    return hashes, counts


def measure(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, host, text_hash, base counts, lines array<hash>, line_words array<int>), a row for each of docs."""
    names = ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for t in batch.column(2):
                text = t.as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                hashes, counts = _line_hashes(raw)
                for column, x in zip(out, (xxhash.xxh3_64_intdigest(raw) - (1 << 63), *base_counts(text), hashes, counts)):
                    column.append(x)
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"{n} long" for n in names[2:8])
    return source.mapInArrow(run, f"doc_id long, host string, {counts}, lines array<long>, line_words array<int>")


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, per_decade: float = PER_DECADE, min_free: float = MIN_FREE, min_kept: float = MIN_KEPT) -> DataFrame:
    """A row for each of docs: doc_id, host, the base counts, base_failed, kept_words (in lines below the limits), kept."""
    rows = materialize(measure(docs, id_col, host_col, text_col), "rules-measured")
    host = F.xxhash64("host").alias("h")
    texts = rows.groupBy(host, F.col("text_hash").alias("t")).agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    texts = materialize(texts, "rules-texts")
    limits = texts.groupBy("h").agg(F.greatest(F.lit(float(min_docs)), per_decade * F.log10(F.count("*").cast("double"))).alias("most"))
    lines = texts.select("h", F.array_sort(F.array_distinct("lines")).alias("all")).select("h", "all", F.posexplode("all").alias("k", "line"))
    frequent = lines.groupBy("h", "line").agg(F.count("*").alias("texts")).filter(F.col("texts") > min_docs)
    first = F.get("all", F.when(F.col("k") == 0, 1).otherwise(0))
    last = F.get("all", F.size("all") - F.when(F.col("k") == F.size("all") - 1, 2).otherwise(1))
    seen = lines.select("h", "line", F.explode(F.array(F.struct(F.lit(0).alias("side"), first.alias("c")), F.struct(F.lit(1).alias("side"), last.alias("c")))).alias("x"))
    seen = seen.join(frequent, ["h", "line"]).groupBy("h", "line", "texts", "x").agg(F.lit(1).alias("one"))
    common = seen.groupBy("h", "line", "texts").agg((F.count("*") / 2).alias("n"))
    common = common.filter((F.col("n") > min_docs) & (F.col("n") >= F.lit(min_free) * F.col("texts")))
    common = common.join(limits, "h").filter(F.col("n") > F.col("most")).select("h", "line")
    pairs = texts.select("h", "t", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    pairs = pairs.select("h", "t", F.col("x.lines").alias("line"), F.col("x.line_words").alias("w"))
    pairs = pairs.groupBy("h", "t", "line").agg(F.sum("w").alias("w"))
    lost = pairs.join(common, ["h", "line"]).groupBy("h", "t").agg(F.sum("w").alias("lost"))
    lost = materialize(lost, "rules-lost")
    release(texts)
    keyed = rows.drop("lines", "line_words").withColumn("h", host).withColumnRenamed("text_hash", "t")
    keyed = keyed.join(lost, ["h", "t"], "left").withColumn("kept_words", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    whole = (F.col("kept_words") >= MIN_WORDS) & (F.col("kept_words") >= F.lit(min_kept) * F.col("n_words"))
    return keyed.withColumn("base_failed", failed).withColumn("kept", ~failed & whole).drop("h", "t", "lost")


def query(spark, sf_dir: str) -> DataFrame:
    found = judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


#: The same rows in DuckDB's SQL.
SQL = r"""
with d as (select doc_id, source, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
u as (select distinct source, t from d),
ul as (select source, t, unnest(string_split(t, chr(10))) l from u),
ln as (select source, t, trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) l,
  len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) k from ul),
ok as (select * from ln where k > 0),
sz as (select source, count(*) n from u group by 1),
lh as (select distinct source, t, l, left(md5(l), 16) h from ok),
two as (select source, t, list_sort(list(h)) hs from lh group by 1, 2),
cx as (select source, l, t, case when h = hs[1] then hs[2] else hs[1] end a, case when h = hs[-1] then hs[-2] else hs[-1] end b
  from lh join two using (source, t)
  union all select lh.source, l, t, case when h = hs[1] then hs[2] else hs[1] end,
  case when h = hs[-1] then hs[-2] else hs[-1] end from lh join two using (t) where lh.source is null and two.source is null),
n as (select source, l, count(*) texts, (count(distinct coalesce(a, '')) + count(distinct coalesce(b, ''))) / 2 n from cx group by 1, 2),
cm as (select n.source, n.l from n join sz on n.source is not distinct from sz.source
  where n.n > greatest(20, 15 * log10(sz.n)) and n.n >= 0.25 * n.texts),
lost as (select o.source, o.t, sum(o.k) lost from ok o join cm on o.source is not distinct from cm.source and o.l = cm.l group by 1, 2),
dl as (select doc_id, source, t, unnest(string_split(t, chr(10))) l from d),
dup as (select doc_id, count(*) - count(distinct l) n from dl where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1),
pos as (select doc_id, ws, unnest(range(1, len(ws) - 6)) p from w where len(ws) >= 8),
win as (select doc_id, p, ws[p:p + 7] x from pos),
twice as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, x) c from win) where c > 1),
rep as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + 8)) q from twice) group by 1),
b as (select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(w.t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
  (length(w.t) - length(translate(w.t, '#*$%&|<>', '')))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines,
  coalesce(rep.n, 0)::bigint n_repeat_words, (len(ws) - coalesce(lost.lost, 0))::bigint kept_words
  from w left join dup using (doc_id) left join rep using (doc_id)
  left join lost on lost.source is not distinct from w.source and lost.t = w.t),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and kept_words >= 20 and kept_words >= 0.3 * n_words as kept, kept_words from f
"""
