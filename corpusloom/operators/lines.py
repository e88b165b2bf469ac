"""Documents as lines: page edges, tables of contents, repeats and paragraphs as window functions.

Lines are rows (doc_id, page_no, line_no, line, is_barrier). Every window partitions by doc_id, or by doc_id
and a finer key that the same hash partitioning serves, so the chain of operators needs one exchange. A
barrier is a removed line of symbols: it keeps its neighbours from being joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as t

#: Limits of the line operators (defaults of the parameters below).
EDGE_LINES, EDGE_CHARS, REPEAT_COUNT, REPEAT_GAP, REPEAT_MIN, REPEAT_MAX = 3, 120, 3, 1000, 8, 120
DUP_CHARS, DUP_PARAGRAPH, LONG_PARAGRAPH, TOC_ENTRIES = 30, 40, 200, 3

def _doc(last: int | None = None):
    """The document's order, with rows from its begin to `last` where given."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    return order if last is None else order.rowsBetween(Window.unboundedPreceding, last)


def clean_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): characters cleaned.

    Whole documents are dealt out by id before they are cleaned: the exchange that the windows need anyway moves fewer rows,
    and a small input, one split, isn't cleaned, segmented and scored by one task. A given number of partitions isn't coalesced.
    """
    spread = docs.select(id_col, text_col).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    # generators, as the filter that Spark infers from an explode is then not pushed below the text, which it would make and clean again
    raw = spread.select(F.col(id_col).alias("doc_id"), F.explode(F.array(F.coalesce(text_col, F.lit("")))).alias("raw"))
    return raw.select("doc_id", F.explode(F.array(t.clean_text(F.col("raw")))).alias("text"))


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, page_no, line_no, line): characters cleaned, form feeds part pages, line feeds part lines."""
    texts = clean_texts(docs, id_col, text_col)
    pages = texts.select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("page_no", "page"))
    return pages.select("doc_id", "page_no", F.posexplode(F.split("page", "\n", -1)).alias("line_no", "line"))


def collapsed(lines: DataFrame) -> DataFrame:
    """N5-N8 of every line. A generator, as a filter on its column isn't pushed below it, where each of the filter's terms would collapse the line again."""
    return lines.withColumn("line", F.explode(F.array(t.collapse_line(F.col("line")))))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines collapsed and trimmed, page-number lines dropped, symbol lines as empty barriers."""
    rows = collapsed(lines).filter(~t.is_page_number(F.col("line")))
    noise = t.is_symbol_noise(F.col("line"))
    return rows.withColumn("is_barrier", noise).withColumn("line", F.when(F.col("is_barrier"), "").otherwise(F.col("line")))


def is_content() -> Column:
    return (F.col("line") != "") & ~F.col("is_barrier")


def mark_edges(lines: DataFrame) -> DataFrame:
    """With is_edge, among the first or last EDGE_LINES content lines of a page, and pages, the document's number of pages."""
    page = Window.partitionBy("doc_id", "page_no", "content")
    rows = lines.withColumn("content", is_content())
    first = F.row_number().over(page.orderBy("line_no"))
    last = F.row_number().over(page.orderBy(F.desc("line_no")))
    rows = rows.withColumn("is_edge", F.col("content") & ((first <= EDGE_LINES) | (last <= EDGE_LINES))).drop("content")
    return rows.withColumn("pages", F.max("page_no").over(Window.partitionBy("doc_id")) + 1)


def _mark_numbers(rows: DataFrame) -> DataFrame:
    """With is_number: bare n or n/m at page edges whose distance to the page's place recurs in at least half the pages."""
    number = F.regexp_extract("line", t.EDGE_NUMBER, 1)
    total = F.regexp_extract("line", t.EDGE_NUMBER, 2)
    shift = F.concat_ws("/", (F.try_to_number(number, F.lit("9999")).cast("int") - F.col("page_no")).cast("string"), total)
    rows = rows.withColumn("shift", F.when(F.col("is_edge") & (number != ""), shift))
    rows = rows.withColumn("seen", F.count("shift").over(Window.partitionBy("doc_id", "shift")))
    found = (F.col("pages") >= 2) & F.col("shift").isNotNull() & (F.col("seen") >= F.greatest(F.lit(2), F.ceil(F.col("pages") / 2)))
    return rows.withColumn("is_number", found).drop("shift", "seen")


def _mark_headers(rows: DataFrame) -> DataFrame:
    """With is_repeated, lines that read as a header or footer, and is_copy, those of them at page edges after the first.

    A header or footer recurs at the edges of at least half the pages, three at least.
    """
    eligible = F.col("is_edge") & (F.length("line") <= EDGE_CHARS) & ~t.is_protected_value(F.col("line"))
    rows = rows.withColumn("key", t.edge_key(F.col("line"), True)).withColumn("eligible", eligible)
    by_page = Window.partitionBy("doc_id", "key", "page_no", "eligible").orderBy("line_no")
    rows = rows.withColumn("page_first", (F.col("eligible") & (F.row_number().over(by_page) == 1)).cast("int"))
    by_key = Window.partitionBy("doc_id", "key")
    upto = by_key.orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("on_pages", F.sum("page_first").over(by_key)).withColumn("nth", F.sum((F.col("eligible") & ~F.col("is_number")).cast("int")).over(upto))
    rows = rows.withColumn("is_repeated", (F.col("pages") >= 2) & (F.col("on_pages") >= F.greatest(F.lit(3), F.ceil(F.col("pages") / 2))))
    return rows.withColumn("is_copy", F.col("eligible") & F.col("is_repeated") & (F.col("nth") > 1)).drop("key", "eligible", "page_first", "on_pages", "nth")


def drop_page_numbers(lines: DataFrame) -> DataFrame:
    """W3."""
    return _mark_numbers(mark_edges(lines)).filter("not is_number").select(*lines.columns)


def drop_page_edges(lines: DataFrame) -> DataFrame:
    """Of a header or footer the first stays."""
    rows = mark_edges(lines).withColumn("is_number", F.lit(False))
    return _mark_headers(rows).filter("not is_copy").select(*lines.columns)


def drop_page_noise(lines: DataFrame) -> DataFrame:
    """W3 and W2 together, by the edges that the page had before anything went; with is_repeated, for join_pages()."""
    rows = _mark_headers(_mark_numbers(mark_edges(lines)))
    return rows.filter("not is_number and not is_copy").select(*lines.columns, "is_repeated")


def drop_toc(lines: DataFrame) -> DataFrame:
    """Runs of three or more contents entries, page numbers rising, two thirds of whose titles occur as lines."""
    title = F.regexp_extract("line", t.folded(t.TOC_ENTRY), 1)
    page = F.when(F.contains("line", F.lit("...")), F.regexp_extract("line", t.folded(t.TOC_ENTRY), 2)).otherwise("")
    entry = is_content() & (page != "")
    rows = lines.withColumn("entry", entry).withColumn("toc_page", F.when(entry, F.try_to_number(page, F.lit("9999")).cast("int")))
    rows = rows.withColumn("key", F.when(entry, t.toc_key(title)).when(is_content(), t.toc_key(F.col("line"))))
    counts = (F.col("line") != "") | F.col("is_barrier")  # blank lines neither belong to a run nor end it
    ordered = Window.partitionBy("doc_id", "counts").orderBy("page_no", "line_no")
    rows = rows.withColumn("counts", counts)
    breaks = ~F.col("entry") | ~F.coalesce(F.lag("entry").over(ordered), F.lit(False)) | (F.col("toc_page") < F.lag("toc_page").over(ordered))
    rows = rows.withColumn("breaks", breaks).withColumn("run", F.sum(F.col("breaks").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    found = F.max((~F.col("entry")).cast("int")).over(Window.partitionBy("doc_id", "key"))
    rows = rows.withColumn("found", F.when(F.col("entry"), found))
    run = Window.partitionBy("doc_id", "counts", "run")
    rows = rows.withColumn("size", F.count("found").over(run)).withColumn("hits", F.sum("found").over(run))
    drop = F.col("entry") & (F.col("size") >= TOC_ENTRIES) & (3 * F.col("hits") >= 2 * F.col("size"))
    return rows.withColumn("drop", drop).filter("not drop").select(*lines.columns)


def drop_repeats(lines: DataFrame) -> DataFrame:
    """Header-like lines that recur at least three times, never closer than a thousand characters: the first stays."""
    rows = lines.withColumn("at", F.coalesce(F.sum(F.greatest(F.length("line"), F.col("is_barrier").cast("int")) + 1).over(_doc(last=-1)), F.lit(0)))
    size = F.length("line")
    fit = is_content() & size.between(REPEAT_MIN, REPEAT_MAX) & t.may_be_header(F.col("line")) & ~t.is_protected_value(F.col("line"))
    rows = rows.withColumn("key", F.when(fit, t.edge_key(F.col("line"), False)))
    by_key = Window.partitionBy("doc_id", "key")
    ordered = by_key.orderBy("page_no", "line_no")
    rows = rows.withColumn("gap", F.col("at") - F.lag("at").over(ordered)).withColumn("rn", F.row_number().over(ordered))
    rows = rows.withColumn("n", F.count("key").over(by_key)).withColumn("least", F.min("gap").over(by_key))
    drop = F.col("key").isNotNull() & (F.col("n") >= REPEAT_COUNT) & (F.col("least") >= REPEAT_GAP) & (F.col("rn") > 1)
    return rows.withColumn("drop", drop).filter("not drop").select(*lines.columns)


def drop_consecutive(lines: DataFrame) -> DataFrame:
    """A line equal to the one before (blank lines aside), of 30 characters or more, unless only table lines precede it.

    Rows of one run of equal lines form an island; a row goes when an earlier row of its island isn't a table line.
    """
    rows = lines.withColumn("solid", (F.col("line") != "") | F.col("is_barrier"))
    ordered = Window.partitionBy("doc_id", "solid").orderBy("page_no", "line_no")
    key = F.when(F.col("is_barrier"), "\x00").otherwise(t.squeeze(F.col("line")))
    rows = rows.withColumn("key", key)
    rows = rows.withColumn("fresh", (~F.col("key").eqNullSafe(F.lag("key").over(ordered))).cast("int"))
    rows = rows.withColumn("island", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("doc_id", "solid", "island").orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    prose = F.max((~t.is_table_like(F.col("line"))).cast("int")).over(earlier)
    drop = F.col("solid") & (F.length("key") >= DUP_CHARS) & (F.coalesce(prose, F.lit(0)) == 1)
    return rows.withColumn("drop", drop).filter("not drop").select(*lines.columns)


def to_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, para_no, lines array<struct<line, is_barrier>>), blank lines part paragraphs."""
    blank = (F.col("line") == "") & ~F.col("is_barrier")
    rows = lines.withColumn("blank", blank)
    rows = rows.withColumn("island", F.sum(F.col("blank").cast("int")).over(_doc(last=0))).filter("not blank")
    grouped = rows.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("page_no", "line_no", "line", "is_barrier"))).alias("rows"))
    para = F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1
    parts = F.transform("rows", lambda r: F.struct(r["line"].alias("line"), r["is_barrier"].alias("is_barrier")))
    return grouped.select("doc_id", para.alias("para_no"), parts.alias("lines"))


def repair_wraps(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_no, lines array<string>): wrapped sentences and hyphenated words rejoined, barriers gone.

    How a line continues the one before depends on the two lines alone, but for one branch that also asks for
    the length of the logical line so far. So joins are decided side by side, and a fold over their results
    only adds up lengths.
    """
    seen = F.transform("lines", lambda x, i: F.struct(x["line"].alias("line"), x["is_barrier"].alias("is_barrier"), ((i > 0) & F.get(F.col("lines.is_barrier"), i - 1)).alias("walled")))
    rows = paragraphs.withColumn("solid", F.filter(seen, lambda x: ~x["is_barrier"]))

    def decide(x: Column, i: Column) -> Column:
        before = F.get(F.col("solid.line"), i - 1)
        first = (i == 0) | x["walled"]
        how = F.when(first, t.JOIN_NONE).otherwise(t.wrap_kind(before, x["line"]))
        return F.struct(x["line"].alias("line"), how.alias("how"))

    rows = rows.withColumn("joins", F.transform("solid", decide))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("chars"))

    def step(state: Column, x: Column) -> Column:
        how = F.when(x["how"] == t.JOIN_LOWER, t.long_enough(state["chars"])).otherwise(x["how"])
        head = F.when(how == t.JOIN_WORD, F.substr(state["now"], F.lit(1), F.length(state["now"]) - 1)).otherwise(state["now"])
        joined = F.struct(
            state["done"].alias("done"), F.concat(head, F.when(how == t.JOIN_SPACE, " ").otherwise(""), x["line"]).alias("now"),
            (state["chars"] + F.length(x["line"]) + F.when(how == t.JOIN_HYPHEN, 0).otherwise(1)).alias("chars"),
        )
        closed = F.struct(
            F.when(state["now"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["now"]))).alias("done"),
            x["line"].alias("now"), F.length(x["line"]).alias("chars"),
        )
        return F.when(how == t.JOIN_NONE, closed).otherwise(joined)

    finish = lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
    return rows.select("doc_id", "para_no", F.aggregate("joins", zero, step, finish).alias("lines")).filter(F.size("lines") > 0)


def drop_duplicate_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Later copies of paragraphs of 200 characters or more; shorter prose only directly after its copy."""
    key = t.squeeze(F.array_join("lines", " "))
    rows = paragraphs.withColumn("key", key)
    copy = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("para_no"))
    rows = rows.withColumn("copy", copy).filter((F.length("key") < LONG_PARAGRAPH) | (F.col("copy") == 1))
    before = F.lag("key").over(Window.partitionBy("doc_id").orderBy("para_no"))
    prose = F.forall("lines", lambda x: (F.length(x) >= DUP_CHARS) & ~t.is_table_like(x))
    again = before.eqNullSafe(F.col("key")) & (F.length("key") >= DUP_PARAGRAPH) & (F.length("key") < LONG_PARAGRAPH) & prose
    return rows.withColumn("again", again).filter("not again").select(*paragraphs.columns)


def join_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, normalized): lines by line feeds, paragraphs by blank lines."""
    grouped = paragraphs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("para_no", "lines"))).alias("paras"))
    return grouped.select("doc_id", F.array_join(F.transform("paras", lambda p: F.array_join(p["lines"], "\n")), "\n\n").alias("normalized"))


def join_pages(lines: DataFrame) -> DataFrame:
    """Pages meet in a blank line, unless the last content line of one runs on into the first of the next.

    A line that is_repeated (where lines have that column), a header or footer, never runs on.
    """
    solid = (F.col("line") != "") | F.col("is_barrier")
    rows = lines.withColumn("solid", solid)
    ordered = Window.partitionBy("doc_id", "solid").orderBy("page_no", "line_no")
    prev, prev_page = F.lag("line").over(ordered), F.lag("page_no").over(ordered)
    meets = F.col("solid") & (prev_page < F.col("page_no"))
    if "is_repeated" in lines.columns:
        meets_text = meets & ~F.col("is_repeated") & ~F.coalesce(F.lag("is_repeated").over(ordered), F.lit(True))
    else:
        meets_text = meets
    open_ = meets_text & ~F.col("is_barrier") & ~F.coalesce(F.lag("is_barrier").over(ordered), F.lit(True))
    rows = rows.withColumn("meets", meets).withColumn("runs_on", open_ & (t.wrap_join(prev, F.col("line"), F.length(prev)) != t.JOIN_NONE))
    # blank lines at the ends of pages go; a page that doesn't run on begins with one
    page = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    upto = F.max(F.col("solid").cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0))
    onward = F.max(F.col("solid").cast("int")).over(page.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("inner", (upto == 1) & (onward == 1)).filter("inner")
    gap = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("line"), F.lit(False).alias("is_barrier")))
    own = F.array(F.struct(F.lit(0).alias("at"), F.col("line").alias("line"), F.col("is_barrier").alias("is_barrier")))
    rows = rows.withColumn("both", F.explode(F.when(F.col("meets") & ~F.col("runs_on"), F.concat(gap, own)).otherwise(own)))
    return rows.select("doc_id", "page_no", (2 * F.col("line_no") + F.col("both.at")).alias("line_no"), F.col("both.line").alias("line"), F.col("both.is_barrier").alias("is_barrier"))


def normalize_by_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """C1 as a chain of the operators above: what whole.normalize() must give."""
    lines = clean_lines(explode_lines(docs, id_col, text_col))
    lines = join_pages(drop_page_noise(lines))
    lines = drop_consecutive(drop_repeats(drop_toc(lines)))
    return join_paragraphs(drop_duplicate_paragraphs(repair_wraps(to_paragraphs(lines))))


def normalize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, normalized) of every document that keeps a line, each document in one pass."""
    from corpusloom.operators import whole

    return whole.normalize(docs, id_col, text_col)
